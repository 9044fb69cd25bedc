"""Storage: generations of Parquet files under manifests, and the store and boxes on top of them."""
