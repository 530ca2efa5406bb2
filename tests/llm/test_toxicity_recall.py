import zlib

import duckdb

from pagewright.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_recall_on_short_and_long_documents():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), toxic FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL").fetchall()
    kept = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    model = toxicity.train([(t, y) for (_, t, y), k in zip(rows, kept, strict=True) if not k])
    found = [(model.score(t) >= toxicity.THRESHOLD, y, len(t)) for (_, t, y), k in zip(rows, kept, strict=True) if k]
    toxic = [(hit, n) for hit, y, n in found if y == 1]
    assert len(toxic) == 144 and sum(hit for hit, _ in toxic) >= 130
    assert sum(hit for hit, n in toxic if n >= 10_000) >= 3
    assert sum(hit for hit, y, _ in found if y == 0) <= 2
