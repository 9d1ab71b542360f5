import pyarrow.parquet as pq


def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
