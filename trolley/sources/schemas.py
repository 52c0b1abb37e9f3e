"""The six order tables: names, file names and column types."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StructField, StructType

# Table names, column names, column types and CSV file names of the input data set.
TABLE_COLUMNS = {
    "aisles": "aisle_id INT, aisle STRING",
    "departments": "department_id INT, department STRING",
    "products": "product_id INT, product_name STRING, aisle_id INT, department_id INT",
    "orders": (
        "order_id INT, user_id INT, eval_set STRING, order_number INT, order_dow INT, "
        "order_hour_of_day INT, days_since_prior_order DOUBLE"
    ),
    "order_products_prior": "order_id INT, product_id INT, add_to_cart_order INT, reordered INT",
    "order_products_train": "order_id INT, product_id INT, add_to_cart_order INT, reordered INT",
}
CSV_FILES = {
    "aisles": "aisles.csv",
    "departments": "departments.csv",
    "products": "products.csv",
    "orders": "orders.csv",
    "order_products_prior": "order_products__prior.csv",
    "order_products_train": "order_products__train.csv",
}

# Ids and counters whose largest value grows with the data; they outgrow 32 bits long before
# 100 TB.
GROWING = frozenset({"order_id", "user_id", "product_id", "order_number"})


def table_schema(name: str, narrow_ids: bool = False) -> StructType:
    """Schema of one table. The growing columns are bigint unless ``narrow_ids`` is set.

    Every column is nullable: Spark's file sources return nullable columns whatever the
    declared schema says, so a NOT NULL here would promise something nobody checks.
    """
    declared = StructType.fromDDL(TABLE_COLUMNS[name])
    if narrow_ids:
        return declared
    return StructType(
        [
            StructField(f.name, LongType())
            if f.name in GROWING and isinstance(f.dataType, IntegerType)
            else f
            for f in declared.fields
        ]
    )
