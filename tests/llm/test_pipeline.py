"""The stages in turn over a small fixture, each against its own decision made again by hand."""

import numpy as np

import corpus_pipeline
from spanloom.llm import mixing, pieces, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = "the house and the people of this town were there when she came with her dogs and they all went to the river".split()
    rows = [(i, " ".join(rng.permutation(base * 3)), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(30, rows[4][1], "en", "s0", 0), (31, "12345 ###", "en", "s1", 0), (32, None, None, None, None), (33, rows[5][1] + " mail bob@example.org now", "en", "s1", 0)]
    (tmp_path / "x").mkdir()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "x" / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "x" / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "x"))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
    assert set(seen["language"].doc_id) == {*range(31), 33}
    prints = {r[0]: simhash.fingerprint(r[1]) for r in rows if r[0] in set(seen["language"].doc_id)}
    links = {i: min(j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
    assert 30 not in set(seen["near_duplicates"].doc_id) and set(seen["near_duplicates"].doc_id) <= set(links.values())
    finder, text = pii.Finder(), dict((r[0], r[1]) for r in rows)
    masked = seen["personal_data"].set_index("doc_id")
    assert all(masked.text[i] == pii.masked(text[i], finder.spans(text[i])) and masked.n_chars[i] == len(masked.text[i]) for i in masked.index)
    copies = mixing.mix(spark.read.parquet(str(tmp_path / "personal_data"))).toPandas().set_index("doc_id").copies
    assert seen["mix"].doc_id.value_counts().to_dict() == {i: n for i, n in copies.items() if n}
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    assert len(seen["tokens"]) == len(seen["mix"]) and all(pieces.decode(m, np.asarray(r.ids)) == masked.text[r.doc_id] for r in seen["tokens"].itertuples())
    drawn = seen["tokens"].groupby("doc_id")
    assert seen["tokens"].round_trip.all() and all(sorted(g.draw) == [*range(1, len(g) + 1)] and len({tuple(x) for x in g.ids}) == len(g) for _, g in drawn)
    assert max(len(g) for _, g in drawn) > 1
    assert corpus_pipeline.run(spark, str(tmp_path / "x")).count() == len(seen["mix"])
