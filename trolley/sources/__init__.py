from trolley.sources.buckets import read_bucketed, write_bucketed
from trolley.sources.publishing import new_set, publish_set, published_set
from trolley.sources.readers import load_tables, split_csv_table
from trolley.sources.samples import sample_tables
from trolley.sources.writers import cluster_by_key, write_csv, write_parquet, write_partitioned

__all__ = [
    "cluster_by_key",
    "load_tables",
    "new_set",
    "publish_set",
    "published_set",
    "read_bucketed",
    "sample_tables",
    "split_csv_table",
    "write_bucketed",
    "write_csv",
    "write_parquet",
    "write_partitioned",
]
