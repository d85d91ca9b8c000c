"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import chat, langid, licenses, mixing, neighbours, oracles, pieces, pii, quality, queries, resemblance, simhash, topk, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size long, key__ long, fp string, copies__ string"
ODD = [None, "", " \t\n", "one", "one two three", "word " * 40_000, "MIT License, é", "MIT License, é", "▁ a b", "x@y.z +1 (555) 123-4567", "a\ufdd0b \u2581\ufdd0 \U0001f600"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "a", "b") for r in rows], DOCS + EXTRA)


def odd(spark):
    rows = [(i, t, "en", ["s1", None, "s2"][i % 3], None) for i, t in enumerate(ODD)]
    return docs(spark, [*rows, rows[6], (None, "one", None, None, None)])


def empty(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), None, ["a", "b", None][min(i % 40, 2)], None) for i in range(600)]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert sorted(got.doc_id) == list(range(600)) and (got.copies <= 3).all() and (got["size"] == [len(rows[i][1].split()) for i in got.doc_id]).all()
    by = got.assign(source=got.source.fillna("~")).groupby("source").agg(s=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    total, weight = by.s.sum(), {"a": 1, "b": 2, "~": 3}
    want, capped = {}, set()
    while True:
        left = total - sum(3 * by.s[x] for x in capped)
        share = sum(w for x, w in weight.items() if x not in capped)
        want = {x: 3 * by.s[x] if x in capped else left * w / share for x, w in weight.items()}
        over = {x for x in weight if x not in capped and want[x] > 3 * by.s[x]}
        if not over:
            break
        capped |= over
    assert capped and all(abs(by.t[x] - want[x]) < 1e-6 for x in weight)
    assert ((by.k - by.t).abs() <= 60).all()
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3)).toPandas()
    assert again.set_index("doc_id").copies.equals(got.set_index("doc_id").copies.loc[again.doc_id])
    taken = mixing.repeat_rows(docs(spark, rows), mixing.mix(docs(spark, rows)))
    assert taken.count() == got.copies.sum() and taken.columns == docs(spark, rows).columns
    o = odd(spark)
    assert mixing.mix(o).count() == o.count() and mixing.repeat_rows(o, mixing.mix(o)).columns == o.columns
    assert mixing.mix(empty(spark)).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, id int, score double")


BAD = [(1000, None), (1020, [float("nan")] * 4), (1050, [1.0, None, 0.0, 0.0]), (1100, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = vectors_of(spark, [*rows, *BAD, (2000, [0.0] * 4)])
    got = neighbours.nearest(frame, k=5, shard=150, block=10).toPandas()
    wide = x.astype(float)
    for q in range(0, 600, 20):
        s = wide @ wide[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and np.allclose(mine.score, s[want])
    near = neighbours.nearest(frame, k=5, factor=3.0, shard=150, block=10).toPandas()
    assert len(near.merge(got, on=["query_id", "vec_id"])) >= 0.9 * len(got)
    few = neighbours.nearest(vectors_of(spark, rows[:3])).toPandas()
    assert sorted(few.vec_id) == [1, 2] and neighbours.nearest(vectors_of(spark, [])).count() == 0


def brute_neighbours(x, q, k):
    with np.errstate(over="ignore", invalid="ignore"):
        scores = neighbours.products(np.broadcast_to(x[q], x.shape), x)
    rank = np.nan_to_num(scores, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    ids = [i for i in np.lexsort((np.arange(len(x)), -rank)) if i != q][:k]
    return ids, rank[ids]


@pytest.mark.parametrize("long", [1e9, 1e16, 1e150, 1e200])
def test_neighbours_of_very_different_lengths(spark, long):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 6))
    x[7] *= long
    x[11] /= long
    x[40] *= long
    x[50:60] = x[50]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, k=8, shard=80, block=6).toPandas()
    for q in range(0, 300, 20):
        ids, scores = brute_neighbours(x, q, 8)
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == ids and mine.score.tolist() == scores.tolist()


def test_shards_grow():
    """Few rows: shards of a fixed size. Many: as many shards as are allowed, of more rows, up to the room that a shard has."""
    assert [vectors.shards_of(n, 64) for n in (0, 1, 4096, 4097, 10_256)] == [1, 1, 1, 2, 3]
    assert vectors.shards_of(4096 * 4096, 64) == 4096 and vectors.shards_of(100_000_000, 64) == 4096
    wide = vectors.ROOM // (8 * 64)
    assert vectors.shards_of(10**9, 64) == -(-(10**9) // wide) and vectors.shards_of(10**9, 10**6) == -(-(10**9) // vectors.SHARD)
    assert vectors.shards_of(1000, 8, shard=10, most=5, room=8 * 8 * 300) == 5 and vectors.shards_of(1000, 8, shard=10, most=2, room=8 * 8 * 300) == 4


def test_neighbours_recall(spark):
    """64 dimensions without structure, the factor of the query, repeated rows and repeated ids."""
    x = np.random.default_rng(15).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (20, x[20].tolist()), (21, x[22].tolist())], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, factor=3.0, shard=1000).toPandas()
    hits = [len({*got.vec_id[got.query_id == q]} & {*brute_neighbours(x, q, 20)[0]}) / 20 for q in range(0, 3000, 20)]
    assert np.mean(hits) >= 0.97 and (got.groupby("query_id").size() == 20).all()


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, size=(500, 4)) / 256  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = topk.top(vectors_of(spark, [*rows, *BAD, *rows[:1]]), shard=100, block=3).toPandas()
    whole = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    for q in range(0, 500, 50):
        s = whole @ whole[q]
        ids = [i for i in [*range(500), 0] if i != q]
        want = sorted(ids, key=lambda i: (-s[i], i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and mine.score.tolist() == [s[i] for i in want]
    assert topk.top(vectors_of(spark, [])).count() == 0


def test_topk_of_large_values(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(200, 4))
    for i, by in ((3, 1e30), (5, -1e30), (9, 1e300), (50, 1e13), (100, 1e300), (120, 1e308)):
        x[i] *= by
    x[70:80] = x[70]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top(frame, shard=60, block=3).toPandas()
    whole = [[int(v) for v in r] for r in topk.whole(x, 256.0)]
    for q in range(0, 200, 50):
        s = [max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(whole[q], r)))) for r in whole]
        want = sorted((i for i in range(200) if i != q), key=lambda i: (-s[i], i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and mine.score.tolist() == [s[i] for i in want]


TALK = {"en": "the house and the people of this town were there when she came with her dogs", "de": "das haus und die leute dieser stadt waren da als sie mit ihren hunden kam", "fr": "la maison et les gens de cette ville étaient là quand elle est venue avec ses chiens", "es": "la casa y la gente de esta ciudad estaban allí cuando ella vino con sus perros"}


def test_language(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(TALK[x].split() * 3)), x, "h1.de", None) for i, x in enumerate(list(TALK) * 15)]
    rows += [(900, "#### 1234", None, None, None), (901, None, None, None, None), (902, "qxz wvk jjq zzx kqv xxj wqz vvk", None, "h2.com", None), (903, "die leute dieser stadt waren da", "en", "h1.de", None)]
    out = langid.identify(docs(spark, rows), declared=F.col("lang"), host=F.col("source"))
    got = out.toPandas().set_index("doc_id")
    assert all(got.lid_language[i] == rows[i][2] for i in range(60))
    assert got.lid_language[900] == "und" and got.lid_language[901] == "und" and got.lid_language[902] == "und" and got.lid_language[903] == "de"
    assert set(langid.accepted(out).toPandas().doc_id) == {*range(60), 903} and langid.accepted(out).columns == docs(spark, rows).columns
    page = spark.createDataFrame([("http://u@News.Example.co.DE:80/x", "<!doctype html><HTML class=a lang='de-AT'>")], "url string, html string")
    h = langid.host_of(F.col("url"))
    r = page.select(h.alias("h"), langid.domain_of(h).alias("d"), langid.suffix_language(h).alias("s"), langid.markup_language(F.col("html")).alias("m")).first()
    assert tuple(r) == ("news.example.co.de", "co.de", "de", "de")
    assert langid.identify(odd(spark), declared=F.col("lang"), host=F.col("source")).count() == len(ODD) + 2
    assert langid.identify(empty(spark), declared=F.col("lang")).count() == 0


def test_language_of_pages(spark, tmp_path):
    def page(i, url, lang, words):
        return (i, url, f"<!doctype html><html lang='{lang}'><head><script>var das='</p>und';</script><style>p{{}}</style></head><body><!-- die leute --><p class=\"haus\">{words}</p>")

    rows = [page(i, f"https://www.{x}{i % 3}.example.org/a", x, " ".join(np.random.default_rng(i).permutation(TALK[x].split() * 3))) for i, x in enumerate(list(TALK) * 12)]
    rows += [page(100, "http://x.beispiel.de/", "zz", ""), page(101, "http://x.example.com/", "", ""), page(102, None, "fr", ""), (103, None, None), (104, "http://a.b.fr/", "<html><script>the house and the people")]
    rows += [page(105, "https://www.de0.example.org/b", "", "da die"), page(106, "https://q.net", "en", "casa &amp; gente de esta ciudad all&iacute; cuando ella vino con sus perros")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op3_language_id(spark, str(tmp_path)).toPandas().set_index("page_id")
    assert len(got) == len(rows) and list(got.language[range(48)]) == list(TALK) * 12 and list(got.text_language[range(48)]) == list(TALK) * 12
    assert list(got.language[[100, 101, 102, 103, 104, 105, 106]]) == ["de", "und", "fr", "und", "fr", "de", "es"]
    assert got.text_language[[100, 101, 102, 103, 104]].isna().all()
    text = spark.createDataFrame([("a<b>c</b>&uuml;<SCRIPT>x</script >y<!-- z",), (None,)], "html string").select(langid.page_text(F.col("html")).alias("t")).collect()
    assert text[0].t.split() == ["a", "c", "ü", "y"] and text[1].t is None


def plain_language(rows, trust=0.9, suffix_trust=0.8, und=0.01, weight=20.0):
    """Posteriors of (text, declared, host) rows in plain Python: whole numbers for hashes, dictionaries for counts."""
    langs, bins, mask = langid.LANGUAGES, langid.BINS, (1 << 64) - 1

    def grams(text):
        letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 and ord(c.lower()) < langid.CODES else c if c.isalpha() and ord(c) < langid.CODES else " " for c in text or "")
        t = " " + " ".join(letters.split()) + " " if letters.strip() else ""
        for a, b, c in zip(map(ord, t), map(ord, t[1:]), map(ord, t[2:])):
            h = ((((a * 0x9E3779B1) ^ (b * 0x85EBCA77)) * 0xC2B2AE3D) + c * 0x27D4EB2F) & mask
            h ^= h >> 29
            yield (h * 0x9E3779B97F4A7C15 & mask) >> 50

    counts = {x: [0] * bins for x in langs}
    for text, said, _ in rows:
        for g in grams(text) if said in counts else []:
            counts[said][g] += 1
    prob = {}
    for x, c in counts.items():
        smooth = [n + 0.5 + 1e-6 * sum(c) / bins for n in c]
        prob[x] = [n / sum(smooth) for n in smooth]
    alone = []
    for text, _, _ in rows:
        g = list(grams(text))
        alone.append([sum(math.log(prob[x][i] * bins) for i in g) / 3 for x in langs] if g else None)
    votes, dom = {}, lambda h: None if h is None else ".".join(h.split(".")[-2:])
    for (_, _, host), ll in zip(rows, alone):
        if ll and max(ll) > 0:
            votes.setdefault(host, [0] * 4)[ll.index(max(ll))] += 1
    whole = [sum(v[i] for v in votes.values()) for i in range(4)]
    world = [(n + 1) / (sum(whole) + 4) for n in whole]
    out = []
    for (_, said, host), ll in zip(rows, alone):
        d = [sum(v[i] for h, v in votes.items() if h is not None and dom(h) == dom(host)) for i in range(4)]
        prior = [(votes[host][i] + weight * (d[i] + weight * w) / (sum(d) + weight)) / (sum(votes[host]) + weight) for i, w in enumerate(world)] if host in votes and host is not None else world
        speaks = [(said if said in langs else None, trust), (langid.SUFFIXES.get(host.split(".")[-1]) if host and "." in host else None, suffix_trust)]
        score = [math.log(p) + math.log(1 - und) + (ll[i] if ll else 0) for i, p in enumerate(prior)] + [math.log(und)]
        for what, t in speaks:
            if what:
                score = [s + math.log(t if x == what else (1 - t) / 3 if x else 1 / 4) for s, x in zip(score, (*langs, ""))]
        blank = not ll and not any(w for w, _ in speaks)
        top = max(score)
        out.append((langid.UND, 1.0) if blank else ((*langs, langid.UND)[score.index(top)], 1 / sum(math.exp(s - top) for s in score)))
    return out


def test_language_against_a_plain_version(spark):
    rng = np.random.default_rng(18)
    hosts = [None, "a.de", "b.a.de", "www.x.com", "m.x.com", "y.com", "solo", "z.fr"]
    rows = []
    for i in range(160):
        of = list(TALK)[i % 4]
        text = " ".join(rng.choice(TALK[of].split(), rng.integers(0, 6))) + ["", " 12 ", "ß Ж", "\n!"][i % 4]
        rows.append((None if i % 29 == 0 else text, [of, None, "zz", "en"][int(rng.integers(4))], hosts[int(rng.integers(len(hosts)))]))
    rows += rows[:5]
    frame = spark.createDataFrame([(i, *r, "x", 0) for i, r in enumerate(rows)], "id long, text string, said string, host string, ll__ string, lid_language long")
    out = langid.identify(frame, declared=F.col("said"), host=F.col("host"))
    assert out.columns == ["id", "text", "said", "host", "ll__", "lid_language", "lid_confidence", "lid_text_language"]
    got, want = out.toPandas().sort_values("id"), plain_language(rows)
    assert np.allclose(got.lid_confidence, [w[1] for w in want]) and got.lid_language.tolist() == [w[0] for w in want]
    assert len({w[0] for w in want}) == 5


def test_trigrams_do_not_depend_on_chunks(monkeypatch):
    t = "Straße, 12 déjà-vu　x" * 40
    whole = np.concatenate(list(langid.trigrams(t)))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.array_equal(np.concatenate(list(langid.trigrams(t))), whole)


def test_pieces(spark):
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    byname = {b: i for i, b in enumerate(m.bytes) if m.weight[i]}

    def every(s):
        return [()] if not s else [(byname[s[:n].encode()], *r) for n in range(1, len(s) + 1) if s[:n].encode() in byname for r in every(s[n:])]

    text = "then a"
    paths = every(" " + text)
    w = np.array([sum(m.weight[i] for i in p) for p in paths])
    p = np.exp(w - np.logaddexp.reduce(w))
    n = 6000
    got = pieces.sample(m, [text] * n, np.array([pieces.row_key(i, "t") for i in range(n)], np.uint64), 2)
    place = {x: i for i, x in enumerate(paths)}
    for draw, want in ((0, p), (1, np.array([sum(p[i] * p[j] / (1 - p[i]) for i in range(len(p)) if i != j) for j in range(len(p))]))):
        share = np.bincount([place[tuple(g[draw][0].tolist())] for g in got], minlength=len(p)) / n
        assert np.abs(share - want).max() < 0.03
    assert abs(np.mean([sum(np.exp(x[1]) / x[3] for x in g) for g in got]) - 1) < 0.02  # inclusion scores are unbiased
    o = odd(spark)
    enc = pieces.decoded(pieces.encode(o.select("doc_id", F.col("text")), k=3)).join(o.select("doc_id", F.col("text").alias("want")), "doc_id").toPandas()
    assert (enc.text == enc.want.fillna("")).all()
    once = enc.drop_duplicates(["doc_id", "draw"])
    assert all(len({tuple(x) for x in g.ids}) == len(g) for _, g in once.groupby("doc_id"))
    assert all(g.sort_values("draw").perturbed.is_monotonic_decreasing for _, g in once.groupby("doc_id"))
    assert pieces.encode(empty(spark)).count() == 0


@pytest.mark.parametrize("chars", [1, 9, 10_000])
def test_pieces_of_long_texts(spark, monkeypatch, chars):
    """In parts the same draws as whole."""
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    rng = np.random.default_rng(20)
    for i, t in enumerate(["a", " ", "", "\u2581 \u2603\u2603x  y", *(" ".join(rng.choice(["house", "the", "x\u2603", "  ", "\n", "un", "likely"], 30)) for _ in range(25))]):
        key = pieces.row_key(i, "t")
        whole, parts = pieces.sample(m, [t], np.array([key], np.uint64), 4)[0], pieces.sample_long(m, t, key, 4, pieces.Units(m), chars)
        if t:
            assert [x[0].tolist() for x in whole] == [x[0].tolist() for x in parts]
            assert np.allclose([x[1:] for x in whole], [x[1:] for x in parts])
            assert all(pieces.decode(m, x[0]) == t for x in parts)


def test_long_texts_in_a_table(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "LONG", 10)
    monkeypatch.setattr(pieces, "BATCH", 8)
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["ab", None, "x" * 11, "abcdefgh", "", "y" * 20])], ["id", "text"])
    assert list(pieces.batches_of(b)) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]


def test_pieces_with_other_batches(monkeypatch):
    m = pieces.Model(open(pieces.MODEL, "rb").read())
    texts, keys = ["a b c", "hello there", "x  y\n"], np.array([1, 2, 3], np.uint64)
    together = pieces.sample(m, texts, keys, 3)
    alone = [pieces.sample(m, [t], keys[i : i + 1], 3)[0] for i, t in enumerate(texts)]
    assert [[(x[0].tolist(), round(x[2], 9)) for x in g] for g in together] == [[(x[0].tolist(), round(x[2], 9)) for x in g] for g in alone]


def brute_pii(t):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii(spark):
    rng, finder = np.random.default_rng(4), pii.Finder()
    parts = ["a", "Z", "@", ".", "-", "+", "1", "22", "333", "4111111111111111", "(", " ", "İ", "٣", "%", "x.y", "a@b.c", "+1 234 5678", "1.2.3.4", "255"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, rng.integers(0, 14)))
        got = finder.spans(t)
        assert {k: got[k] for k in pii.BASE} == brute_pii(t), t
    more = finder.spans("see HTTPS://a.b/c?d=1. IBAN DE89 3704 0044 0532 0130 00, IBAN DE00 3704 0044 0532 0130 00; account number: 12345678")
    assert more["url"] == [(4, 21)] and len(more["account"]) == 2
    rows = pii.find(odd(spark)).toPandas()
    last = rows[rows.doc_id == 9].iloc[0]
    spans = pii.listed(brute_pii(ODD[9]), pii.BASE)
    assert (last.n_email, last.n_phone, last.spans, last.base_sha256) == (1, 1, spans, hashlib.sha256(spans.encode()).hexdigest())
    assert rows.base_sha256[0] == hashlib.sha256(b"").hexdigest() and pii.find(empty(spark)).count() == 0
    masked = pii.mask(odd(spark))
    assert masked.columns == odd(spark).columns
    r = masked.where("doc_id = 9").first()
    assert r.text == "[EMAIL] [PHONE]" and r.n_chars == len(r.text)


@pytest.mark.parametrize("text, want", [
    ("IBAN GB82 WEST 1234 5698 7654 32", ["GB82 WEST 1234 5698 7654 32"]), ("iban: NL91 ABNA 0417 1643 00.", ["NL91 ABNA 0417 1643 00"]),
    ("IBAN DE89370400440532013000 3 days", ["DE89370400440532013000"]), ("IBAN DE89 3704 0044 0532 0130 00 2021", ["DE89 3704 0044 0532 0130 00"]),
    ("IBAN GB82WEST12345698765432 and so on", ["GB82WEST12345698765432"]), ("Kontonummer: GB82-WEST-1234-5698-7654-32 x", ["GB82-WEST-1234-5698-7654-32"]),
    ("IBAN MT84 MALT 0110 0001 2345 MTLC AST0 01S", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
    ("IBAN GB82 WEST 1234 5698 7654 33", []), ("IBAN DE89370400440532013000X", []), ("IBAN", []), ("acct 1234 5678 9012", ["1234 5678 9012"]), ("acct 12345", []),
    ("acct " + "12345678 " * 5, [("12345678 " * 4).strip()]), ("IBAN GB82 WEST 1234 5698 7654 32 IBAN NL91ABNA0417164300", ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300"]),
])
def test_accounts_in_print(text, want):
    found = pii.Finder().spans(text)
    assert [text[a:b] for a, b in found["account"]] == want
    assert all(w not in pii.masked(text, found) for w in want)


def test_quality(spark):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(240):
        good = i % 3 > 0
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(40)]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 8), None, None, None))
        marks.append((i, int(good), 0))
    labels = spark.createDataFrame([*marks, (None, 1, 0), (5000, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs(spark, rows), labels).toPandas().set_index("doc_id")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    truth = np.array([m[1] for m in marks])
    assert (got.predicted[range(240)] == truth)[got.held_out[range(240)]].mean() > 0.95 and got.score.between(0, 1).all()
    assert quality.score(odd(spark), labels.limit(0)).toPandas().score.eq(0.5).all() and quality.score(empty(spark), labels).count() == 0
    assert quality.score(odd(spark), labels).count() == len(ODD) + 2


def plain_features(text):
    """The measures by their names, from characters and lists."""
    text = text or ""
    raw, words = text.encode(), text.split()
    n, m = max(1, len(raw)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    odd = {b for b in range(128) if not (chr(b).isalnum() or chr(b) in " \t\n\v\f\r,.")}
    pairs = list(zip(words, words[1:]))
    share = lambda f: sum(map(f, raw)) / n
    each = lambda f: sum(map(f, words)) / m
    most = lambda xs: max((xs.count(x) for x in set(xs)), default=0)
    values = {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "word_length": each(len), "upper": share(lambda b: 65 <= b <= 90), "digits": share(lambda b: 48 <= b <= 57),
        "symbols": share(lambda b: b in odd), "exclaim": share(lambda b: b == 33), "pipes": share(lambda b: b == 124), "stops": sum(b in b",." for b in raw) / m, "distinct_words": len(set(words)) / m,
        "distinct_lines": len(set(lines)) / max(1, len(lines)), "top_word": most(words) / m, "same_next": sum(a == b for a, b in pairs) / m, "all_caps_words": each(lambda w: len(w) > 1 and w.isupper()),
        "words_with_symbols": each(lambda w: not w[-1].isalnum() and w[-1] not in ".,"), "line_length": math.log1p(n / max(1, len(lines))), "symbol_kinds": len({b for b in raw if b in odd}),
        "top_bigram": most(pairs) / m, "capital_starts": each(lambda w: w[0].isupper()), "repeated_line_share": sum(lines.count(x) > 1 for x in lines) / max(1, len(lines)),
    }
    return [values[name] for name in quality.NAMES]


def test_quality_against_a_plain_version(spark):
    """Features, the optimum of the pairs' logistic loss, the quantile, and the scores that follow."""
    rng = np.random.default_rng(19)
    texts = [t for t in ODD if t is None or len(t) < 1000] + ["A b. A b!\nA b.\n\n| É ÀÉ 12, x-"] + [" ".join(rng.choice(["ab", "Cd,", "EF", "g.", "12", "!!"], 12)) for _ in range(150)]
    assert all(np.allclose(quality.features(t), plain_features(t)) for t in texts)
    values = np.array([plain_features(t) for t in texts])
    good = np.array([("EF" in (t or "")) != (rng.random() < 0.2) for t in texts])
    cuts, w, middle = quality.fit(values, good, share=0.6)
    pick = np.random.default_rng(7)
    up, down = pick.choice(np.flatnonzero(good), quality.PAIRS), pick.choice(np.flatnonzero(~good), quality.PAIRS)
    steps = np.array([[float(v > c) for v, cs in zip(row, cuts) for c in cs] for row in values])
    assert np.allclose(cuts, [[np.quantile(column, q) for q in np.linspace(0, 1, quality.STEPS + 2)[1:-1]] for column in values.T])
    slope = -w.copy()
    for a, b in zip(up, down):
        d = steps[a] - steps[b]
        slope += d / (1 + math.exp(d @ w))
    assert np.abs(slope).max() < 1e-3  # a convex loss is least where its slope is nothing
    strength = steps @ w
    above = sum(0.6 / good.sum() if g else 0.4 / (~good).sum() for g, x in zip(good, strength) if x > middle)
    assert abs(above - 0.6) < 0.05
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    got = quality.score(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), labels).toPandas().sort_values("doc_id")
    seen = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    order = {i: k for k, i in enumerate(r.id for r in spark.createDataFrame([(i,) for i in seen], "id long").orderBy(F.xxhash64("id")).collect())}
    seen.sort(key=order.__getitem__)
    cuts, w, middle = quality.fit(values[seen], good[seen], float(good[seen].mean()))
    steps = np.array([[float(v > c) for v, cs in zip(row, cuts) for c in cs] for row in values])
    assert np.allclose(got.score, [1 / (1 + math.exp(-(x - middle + math.log(0.7 / 0.3)))) for x in steps @ w])


def test_licenses(spark):
    rng = np.random.default_rng(8)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()} | {"foo", "bar"})
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary, rng.integers(1, 9))) for _ in range(3)), None, None, None) for i in range(60)]
    rows += [(100 + i, f"x {t.upper()}.\nMIT, License! é mit license", None, None, None) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = licenses.scan(docs(spark, rows)).toPandas().set_index("doc_id")
    for i, t, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        base, share = {x for _, x in at}, 0.0
        found = set(base)
        for block in low.split("\n"):
            held = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", block))
            for label, template in licenses.TEMPLATES:
                need = set(template.split())
                if len(held & need) >= licenses.THRESHOLD * len(need) - 1e-9:
                    found.add(label)
                    share = max(share, len(held & need) / len(need))
        r = got.loc[i]
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(words), len(at), ",".join(sorted(base)), ",".join(sorted(found))) and abs(r.score - share) < 1e-9
        assert not at or (r.first_word, r.last_word) == (min(at)[0], max(at)[0])
    assert licenses.scan(odd(spark)).count() == len(ODD) + 2 and licenses.scan(empty(spark)).count() == 0


def test_license_windows(spark):
    rng = np.random.default_rng(10)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()} | {"foo", "bar"})
    named = dict(licenses.TEMPLATES)
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary, rng.integers(1, 9))) for _ in range(rng.integers(1, 20))), None, None, None) for i in range(40)]
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        for k in range(3):  # wrapped in the middle, behind 0 to 60 other words
            rows.append((100 + 3 * i + k, "foo " * (30 * k) + "\n# ".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]) + " bar" * 40, None, None, None))
    rows.append((200, "all " + "foo " * 50 + "rights " + "foo " * 50 + "reserved released " + "foo " * 9 + "under the mit bar bar bar license", None, None, None))
    got = licenses.scan(docs(spark, rows), windows=True).toPandas().set_index("doc_id")
    for i, t, *_ in rows:
        words, found, share = re.findall(r"[a-z0-9]+", t), set(), 0.0
        found |= {label for p, label in licenses.BASE if f" {p} " in f" {' '.join(words)} "}
        for label, template in licenses.TEMPLATES:
            need, width = set(template.split()), int(len(template.split()) / licenses.THRESHOLD + 1e-9)
            most = max(len(need & set(words[a : a + width])) for a in range(max(1, len(words) - width + 1)))
            if most >= licenses.THRESHOLD * len(need) - 1e-9:
                found.add(label)
                share = max(share, most / len(need))
        assert got.labels[i] == ",".join(sorted(found)) and abs(got.score[i] - share) < 1e-9, (i, t)
    assert all(label in got.labels[100 + 3 * i + k].split(",") for i, label in enumerate(named) for k in range(3)) and got.labels[200] == ""
    assert licenses.scan(odd(spark), windows=True).count() == len(ODD) + 2 and licenses.scan(empty(spark), windows=True).count() == 0


def threads(rows, part, distinct=True):
    """Plain version of ``chat.conversations`` for rows with a conversation and a turn, and few rows at a turn."""
    def parse(text):
        out, last = [], None
        for line in re.split("\r?\n", text):
            m = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            body = re.sub(r"[\x01\x02\x09-\x0D\x20]+", " ", line[m.end() if m else 0 :].lower()).strip(" ")
            level = m[0].count(">") if m else 0
            if body and (last is None or last[0] != level):
                out.append((level, []))
            if body:
                out[-1][1].append(body)
            last = (level,) if body else None
        return out

    out = []
    for conv in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == conv]
        turns, first = sorted({r[1] for r in own}), {}
        for _, turn, _, text in sorted(own, key=lambda r: r[1]):
            for level, body in parse(text or ""):
                for x in [" ".join(body), *body] if level == 0 else []:
                    first.setdefault(x, turn)
        about, quoted = {t: [0, 0] for t in turns}, {}
        for _, turn, _, text in own:
            links = []
            for level, body in parse(text or ""):
                if level:
                    before = lambda x, turn=turn: first[x] if first.get(x, turn) < turn else None
                    owner = before(" ".join(body))
                    if owner is None and len(body) > 1:
                        owner = max((o for o in map(before, body) if o is not None), default=None)
                    about[turn][0] += 1
                    if owner is not None:
                        about[turn][1] += 1
                        links.append((level, -owner))
            if links:
                quoted[turn] = min([*links, *([quoted[turn]] if turn in quoted else [])])
        thread, nth, prev, laid = None, 0, None, {}
        for t in turns:
            reply = -quoted[t][1] if t in quoted else prev
            if prev is None or reply != prev:
                thread, nth = t, 0
            laid.setdefault((thread, nth // part), []).append((t, reply))
            prev, nth = t, nth + 1
        for (thread, n), held in laid.items():
            said = sorted({(t, r[2] or "user", "\n".join(x for x in re.split("\r?\n", r[3] or "") if not re.match(r"[ \t]*>", x))) for t, _ in held for r in own if r[1] == t})
            said = [(t, role, re.sub(r"\A[\x09-\x0D\x20]*\n", "", body).rstrip("\t\n\x0b\f\r ")) for t, role, body in said]
            said = sorted(set(said))
            text = "".join(f"<|{role}|>\n{body}\n<|end|>\n" for _, role, body in said)
            out.append((conv, thread, n, held[0][1], held[0][0], held[-1][0], len(said), sum(about[t][0] for t, _ in held), sum(about[t][1] for t, _ in held), text))
    return sorted(out, key=str)


CHAT = "conv_id long, turn long, role string, text string"
ROW = ["conv_id", "thread", "part", "reply_to", "first_turn", "last_turn", "n_messages", "n_quotes", "n_linked", "text"]


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello  World\nsecond line"), (1, 1, "assistant", "> hello world\n> second line\nMy answer\n\nmore text"), (1, 2, "user", ">> hello world\n>> second line\n> My answer\nThanks"),
        (1, 3, "user", "> unknown\nnew root"), (1, 4, "assistant", "> second line\nlate reply"), (1, 5, "user", "> late reply\n\n> new root\nboth"), (1, None, "user", "> x"), (None, 1, None, None), (2, 0, "user", None), (2, 1, "user", ""),
    ]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], CHAT + ", thread int, body string")
    whole = [r for r in rows if r[0] is not None and r[1] is not None]
    quoted = {(r.conv_id, r.turn): r for r in chat.replies(spark.createDataFrame(whole, CHAT).where("text is not null")).collect()}
    assert [quoted[1, t].quoted if (1, t) in quoted else None for t in range(6)] == [None, 0, 1, None, 0, 4]
    assert (quoted[1, 2].n_quotes, quoted[1, 2].n_linked) == (2, 2)
    got = chat.conversations(frame, part=2, span=3).collect()
    assert sorted((tuple(r[n] for n in ROW) for r in got if r.thread is not None), key=str) == threads(whole, 2)
    alone = sorted(((r.conv_id, r.first_turn, r.text) for r in got if r.thread is None), key=str)
    assert alone == [(1, None, "<|user|>\n\n<|end|>\n"), (None, 1, "<|user|>\n\n<|end|>\n")]
    texts = {(r.thread, r.part): r.text for r in got if r.conv_id == 1 and r.thread is not None}
    assert list(texts[0, 0].split("<|end|>\n")[:2]) == ["<|user|>\nHello  World\nsecond line\n", "<|assistant|>\nMy answer\n\nmore text\n"] and (4, 0) in texts
    assert chat.conversations(frame.limit(0)).count() == 0
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = c.execute(oracles.SQL["op8_chat"])
    names = [x[0] for x in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in chat.conversations(frame).collect())


@pytest.mark.parametrize("span", [3, 4096])
def test_chat_of_random_quotes(spark, span):
    rng = np.random.default_rng(17)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(30):
            own = "\n".join(" ".join(rng.choice(["Ab", "c", "dE", "f\t"], 2)) for _ in range(rng.integers(0, 4)))
            head = []
            for _ in range(rng.integers(0, 3)):
                of = texts[rng.integers(len(texts))].split("\n") if texts else ["x"]
                a = rng.integers(len(of))
                mark = rng.choice([">", "> ", " > > ", ">>"])
                head.append("\n".join(mark + x for x in of[a : a + rng.integers(1, 4)]) + rng.choice(["\n", "\r\n\n", "\n \n"]))
            texts.append("".join(head) + own)
            for _ in range(1 + (turn == 5)):  # a repeated row
                rows.append((conv, turn * (1 + conv % 3), ["user", None][turn % 2], texts[-1]))
            if turn == 6:
                rows.append((conv, turn * (1 + conv % 3), "user", "another"))
    got = chat.conversations(spark.createDataFrame(rows, CHAT).repartition(3), part=4, span=span).collect()
    assert sorted((tuple(r[n] for n in ROW) for r in got), key=str) == threads(rows, 4)
    assert sum(r.n_linked for r in got) > 200


def test_chat_links_excerpts(spark):
    rows = [
        (1, 0, "user", "thanks\nl0"), (1, 1, "user", "thanks\nl1 \nL2\nl3"), (1, 2, "assistant", "> l1\n> l2\nanswer"), (1, 3, "user", "> l2\n> l3\n\n> nowhere\n> at all\nmore"),
        (1, 4, "user", ">> l1\n>> l2\n> answer\nthird"), (1, 5, "user", "> thanks\n> l1\nfourth"), (1, 6, "user", "> seventh\n> eighth\nx"), (1, 7, "user", "zeroth\nseventh\neighth"),
        (1, 8, "user", "> answer\n> only here\nfifth"),
    ]
    got = {r.turn: r for r in chat.replies(spark.createDataFrame(rows, CHAT).repartition(3)).collect()}
    assert [got[t].quoted if t in got else None for t in range(9)] == [None, None, 1, 1, 2, 1, None, None, 2]
    assert (got[3].n_quotes, got[3].n_linked, got[4].n_quotes, got[4].n_linked) == (2, 1, 2, 2)


def test_chat_of_long_messages(spark):
    """Work follows the length of a message, and a turn with many rows is dealt to several parts."""
    long = "\n".join(f"> line {i}" if i % 2 else f"own {i}" for i in range(60_000))
    rows = [(1, 0, "user", "\n".join(f"line {i}" for i in range(3))), (1, 1, "user", long), *((2, 0, "user", f"m{i}") for i in range(300))]
    got = chat.conversations(spark.createDataFrame(rows, CHAT)).collect()
    first = [r for r in got if r.conv_id == 1]
    assert sum(r.n_quotes for r in first) == 30_000 and sum(r.n_linked for r in first) == 1 and sum(r.text.count("own ") for r in first) == 30_000
    other = [r for r in got if r.conv_id == 2]
    assert len(other) > 2 and sum(r.n_messages for r in other) == 300 and max(r.n_messages for r in other) < 150


def test_covering():
    for turn in range(3):
        kept = simhash.masks(4, turn)
        assert len(kept) == 31
        rng = np.random.default_rng(turn)
        for _ in range(2000):
            bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(int(k) & bits == 0 for k in kept)


@pytest.mark.parametrize("most", [4096, 3])
def test_simhash(spark, most):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows = []
    for i in range(40):
        body = list(rng.choice(words, 220))
        rows += [(len(rows) + k, " ".join(body[:200] + list(rng.choice(words, k % 3))), None, None, None) for k in range(1 + i % 4)]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(7, rows[7][1], None, None, None), (None, "one", None, None, None)]
    found = simhash.near_duplicates(docs(spark, rows), most=most).toPandas()

    def brute(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [brute(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[top(i)] = top(j)
    group: dict = {}
    for i, r in enumerate(rows):
        group.setdefault(top(i), []).append(r[0])
    want = sorted((str(r[0]), prints[i], min(x for x in group[top(i)] if x is not None)) for i, r in enumerate(rows))
    got = sorted((str(None if a != a else int(a)), b & (2**64 - 1), int(c)) for a, b, c in zip(found.doc_id, found.fp.tolist(), found.component_id))
    assert got == want
    if most == 3:
        kept = simhash.one_of_each(docs(spark, rows))
        assert sorted(r.doc_id for r in kept.collect()) == sorted({min(x for x in g if x is not None) for g in group.values()}) and kept.columns == docs(spark, rows).columns
        assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [16, 1])
def test_resemblance(spark, most):
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows = []
    for i in range(30):
        body = list(rng.choice(vocabulary, 200))
        rows.append((len(rows), " ".join(body), None, None, None))
        for changed in (1, 3, 4, 6, 9):  # each changed word touches five shingles
            copy = list(body)
            for k in rng.choice(200, changed, replace=False):
                copy[k] = "zz" + copy[k]
            rows.append((len(rows), " ".join(copy), None, None, None))
    family = list(rng.choice(vocabulary, 200))  # one large bucket after another, with several components in them
    for i in range(150):
        copy = list(family)
        for k in rng.choice(200, int(rng.integers(0, 16)), replace=False):
            copy[k] = f"yy{i}"
        rows.append((len(rows), " ".join(copy), None, None, None))
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "one", None, None, None)]

    def held(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [held(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            root[max(top(i), top(j))] = min(top(i), top(j))
    found = resemblance.near_duplicates(docs(spark, rows), most=most).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in found) == sorted((str(r[0]), rows[top(i)][0]) for i, r in enumerate(rows))
    kept = simhash.one_of_each(docs(spark, rows), found=resemblance.near_duplicates(docs(spark, rows)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[top(i)][0] for i in range(len(rows))})
    assert resemblance.near_duplicates(empty(spark)).count() == 0


def similar(a, b):
    x, y = (set(resemblance.shingles(t).tolist()) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y) - 1e-9


def test_resemblance_goes_through_simhash(spark, monkeypatch):
    """Without any MinHash bucket the links within four bits that hold on the whole sets are there, and no others."""
    rng = np.random.default_rng(31)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    texts = []
    for _ in range(12):
        body = list(rng.choice(vocabulary, 150))
        texts += [" ".join(body), " ".join([*body, "more"]), " ".join(body[:140]), " ".join([*body[:70], *rng.choice(vocabulary, 80)])]
    texts += ["a b c d e f", "a b c d e f g", "", None]
    prints = [simhash.fingerprint(t) for t in texts]
    want = list(range(len(texts)))
    for _ in want:  # labels run along the links
        for i, j in itertools.permutations(range(len(texts)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and similar(texts[i], texts[j]):
                want[i] = min(want[i], want[j])
    assert 12 <= sum(w != i for i, w in enumerate(want))
    shared = resemblance.shared_buckets
    monkeypatch.setattr(resemblance, "shared_buckets", lambda distinct: shared(distinct).limit(0))
    found = resemblance.near_duplicates(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert [r.component_id for r in sorted(found, key=lambda r: r.doc_id)] == want


def test_resemblance_of_many_with_one_passage(spark, monkeypatch):
    """Sets around a hub that share a passage which the hub has not: few of their pairs are compared, those that are alike among them."""
    rng = np.random.default_rng(32)
    words = lambda n, of: [f"{of}{k}" for k in rng.integers(0, 10**6, n)]
    family, passage, texts = words(100, "f"), words(12, "p"), []
    texts.append(" ".join(family))
    for i in range(120):
        body = family + words(10, f"x{i}y") + passage + words(10, f"z{i}y")
        texts += [" ".join(body)] + ([" ".join([*body, "tail"])] if i % 30 == 0 else [])
    counts, compared = [], resemblance.compared
    monkeypatch.setattr(resemblance, "compared", lambda pairs, sets: counts.append(pairs.count()) or compared(pairs, sets))
    found = resemblance.near_duplicates(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    want = [next(j for j, u in enumerate(texts) if similar(t, u)) for t in texts]
    assert [r.component_id for r in sorted(found, key=lambda r: r.doc_id)] == want and len(set(want)) == 121
    assert sum(counts) < 10 * len(texts)


@pytest.mark.parametrize("rare", [2, 30])
def test_quality_learns_from_all_rows(spark, rare):
    """Several blocks: cuts, weights and threshold are those of all rows, whose pairs are drawn block by block."""
    rng = np.random.default_rng(41)
    rows = [(i, int(i % rare > 0), [float(x) for x in np.round(rng.normal(0.2 * (i % rare > 0), 1, len(quality.NAMES)), 1)]) for i in range(600)] + [(7, 1, [0.5] * len(quality.NAMES))] * 5
    values, good = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]) == 1
    seen, sums = [], quality.sums_of
    frame = spark.createDataFrame(rows, "id long, good int, f array<double>")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "sums_of", lambda blocks, w: seen.append(blocks) or sums(blocks, w))
        cuts, w, middle = quality.learn(frame, 0.6, block=100)
    assert np.allclose(cuts, np.quantile(values, np.linspace(0, 1, quality.STEPS + 2)[1:-1], axis=0).T)
    held = [b.rows for b in seen[0].collect()]
    assert len(held) == -(-max(good.sum(), (~good).sum()) // 100) > 1 and all({r.good for r in b} == {0, 1} for b in held)
    assert len({(r.salt, r.good) for b in held for r in b}) == len(rows)
    first = -w
    for b in held:
        x = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8))[: len(w)] for r in b], float)
        up, down = quality.drawn(np.array([r.good for r in b]) == 1)
        d = x[up] - x[down]
        first = first + d.T @ (1 / (1 + np.exp(d @ w)))
    assert np.abs(first).max() < 1e-2
    strength = quality.steps(values, cuts) @ w
    weight = np.where(good, 0.6 / good.sum(), 0.4 / (~good).sum())
    assert abs(weight[strength > middle].sum() - 0.6) <= weight.max() + 1e-9 or np.isclose(strength, middle).any()
