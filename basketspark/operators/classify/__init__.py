"""Training and evaluating spending-class predictors."""
