"""Customer segmentation."""
