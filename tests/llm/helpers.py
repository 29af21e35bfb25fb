"""Rows in the shape of the project's tables, with what the operators don't read filled in to clash."""

CARD = "id string, fingerprint string, front_original string, back_original string, front_normalized string, back_normalized string, tags_resolved string, status string, ingest_batch string, created_at string, key string, n bigint, text string, batch string"
NOTE = "note_id bigint, front_normalized string, back_normalized string, fingerprint string, embedding_vector string, indexed_at string, tid bigint, text string, v string"


def cards(spark, rows):
    """rows: (id, front, back, other columns by name)."""
    out = []
    for id_, front, back, *more in rows:
        more = more[0] if more else {}
        low = lambda s: None if s is None else s.lower()
        base = {"id": id_, "front_original": front, "back_original": back, "front_normalized": low(front), "back_normalized": low(back), "status": "aprobada", "ingest_batch": "b1", "created_at": "2024-01-01", "key": "x", "n": 1, "text": "y", "batch": "z"}
        base |= more
        out.append(tuple(base.get(c.split()[0]) for c in CARD.split(", ")))
    return spark.createDataFrame(out, CARD)


def notes(spark, rows):
    out = []
    for id_, front, back, *more in rows:
        base = {"note_id": id_, "front_normalized": front, "back_normalized": back, "indexed_at": "2024-01-01", "tid": 7, "text": "y", "v": "z"} | (more[0] if more else {})
        out.append(tuple(base.get(c.split()[0]) for c in NOTE.split(", ")))
    return spark.createDataFrame(out, NOTE)


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)), "a row repeats"
    return set(rows)
