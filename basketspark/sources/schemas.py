"""Fixed schemas; nothing is inferred on read."""

from pyspark.sql import types as T

RAW_LINES = T.StructType(
    [
        T.StructField("basket_id", T.StringType()),
        T.StructField("basket_ts", T.TimestampNTZType()),
        T.StructField("sale", T.StringType()),
        T.StructField("customer_id", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("prod_id", T.StringType()),
        T.StructField("prod_descr", T.StringType()),
        T.StructField("qta", T.IntegerType()),
    ]
)

LINES = T.StructType(
    [
        T.StructField("basket_id", T.StringType()),
        T.StructField("basket_ts", T.TimestampNTZType()),
        T.StructField("sale", T.StringType()),
        T.StructField("customer_id", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("prod_id", T.StringType()),
        T.StructField("prod_descr", T.StringType()),
        T.StructField("qta", T.IntegerType()),
    ]
)

# header of the tab-separated export -> our names
RAW_HEADER = {
    "BasketID": "basket_id",
    "BasketDate": "basket_ts",
    "Sale": "sale",
    "CustomerID": "customer_id",
    "CustomerCountry": "country",
    "ProdID": "prod_id",
    "ProdDescr": "prod_descr",
    "Qta": "qta",
}

LINES = T.StructType(
    [
        T.StructField("basket_id", T.LongType()),
        T.StructField("prod_id", T.StringType()),
        T.StructField("prod_descr", T.StringType()),
        T.StructField("sale", T.DecimalType(18, 4)),
        T.StructField("qta", T.LongType()),
        T.StructField("purchase_ts", T.TimestampNTZType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("country", T.StringType()),
    ]
)

PROFILE = T.StructType(
    [T.StructField("customer_id", T.LongType())]
    + [
        T.StructField(n, t)
        for n, t in [
            ("recency", T.LongType()),
            ("frequency", T.LongType()),
            ("monetary", T.DoubleType()),
            ("tot_items", T.LongType()),
            ("max_items", T.LongType()),
            ("mean_basket_items", T.LongType()),
            ("unique_items", T.LongType()),
            ("p_return", T.DoubleType()),
            ("max_sale", T.DoubleType()),
            ("mean_basket_sale", T.DoubleType()),
            ("mean_item_sale", T.DoubleType()),
            ("e_prods", T.DoubleType()),
            ("e_sale", T.DoubleType()),
            ("e_baskets", T.DoubleType()),
            ("e_intervals", T.DoubleType()),
            ("purchasing_freq", T.DoubleType()),
            ("weekday_pref", T.LongType()),
            ("weekmonth_pref", T.LongType()),
            ("item_pref", T.StringType()),
            ("main_country", T.StringType()),
        ]
    ]
)
NUMERIC_PROFILE = [
    f.name for f in PROFILE.fields if f.name != "customer_id" and not isinstance(f.dataType, T.StringType)
]

LABELLED = T.StructType(
    [T.StructField("customer_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("recency", "frequency", "mean_basket_items")]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "e_prods",
            "e_sale",
            "e_baskets",
            "e_intervals",
            "purchasing_freq",
            "mean_item_sale_basket",
            "cat0",
            "cat1",
            "cat2",
        )
    ]
    + [T.StructField("label", T.IntegerType())]
)
CLASS_FEATURES = [f.name for f in LABELLED.fields if f.name not in ("customer_id", "label")]
