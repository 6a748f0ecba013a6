"""Operators over whole tables: divergence of sources, shards, whitening."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewise.llm import divergence, queries, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "And", "Élan", "inges", "ÉLAN", "blean", "ouhe", "of", "stwh", "naïve", "你好", "anly", "q7x", "onion", "reing"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(rows)], DOCS)


def no_rows(spark, columns=DOCS):
    return spark.createDataFrame([], columns)


class TestDivergence:
    def brute(self, rows):
        texts = [(lang or "", source or "", re.findall(r"[^\x00-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for t, lang, source in rows]
        found = []
        for lang in {x[0] for x in texts}:
            own = [x for x in texts if x[0] == lang]
            seen = Counter(w for x in own for w in set(x[2]))
            kept = sorted(w for w, n in seen.items() if n >= 10)
            sources = sorted({x[1] for x in own}, key=lambda s: s.encode())
            counts = {s: Counter(w for x in own if x[1] == s for w in x[2] if seen[w] >= 10) for s in sources}
            counts[None] = sum(counts.values(), Counter())
            p = {s: {w: 1 + 1000000000 * (c[w] + 2) // (c.total() + 2 * len(kept)) for w in kept} for s, c in counts.items()}
            gap = lambda a, b: (a - b) ** 2 // (a + b)
            for s in sources:
                pairs = [(o, sum(gap(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
                terms = [(w, gap(p[s][w], p[None][w])) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
                for part, values, most in (("pair", pairs, None), ("term", terms, 10)):
                    ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:most]
                    found += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
        return sorted(found)

    def rows(self, n=160):
        rng = np.random.default_rng(3)
        rows = []
        for _ in range(n):
            source = "hot" if rng.random() < 0.4 else f"s{rng.integers(4)}"
            words = rng.choice(WORDS, rng.integers(0, 40), p=np.roll(np.arange(1, 16) / 120, hash(source) % 1 + len(source)))
            rows.append((" ".join(words), str(rng.choice(["en", "de", "x"], p=[0.6, 0.35, 0.05])), source))
        return rows + [(None, "en", "empty"), ("", None, None), (None, None, "é"), ("the " * 30000, "en", "long"), ("zz", "one", "single")] + rows[:5]

    @pytest.mark.parametrize("sent", [1 << 16, 0])
    def test_against_brute_force(self, spark, monkeypatch, sent):
        rows = self.rows()
        monkeypatch.setattr(divergence, "SENT_GROUPS", sent)
        docs = frame(spark, rows).withColumns({"index": F.lit(7), "counts": F.lit("clash"), "term": F.lit("t")})
        found = divergence.audit(docs)
        assert found.columns == list(divergence.RESULT)
        assert sorted(map(tuple, found.collect())) == self.brute(rows)

    def test_odd_tables(self, spark):
        assert divergence.audit(no_rows(spark)).count() == 0
        few = [("a b c", "en", "s"), (None, "en", "t"), ("a", "en", "u")]  # no term in ten documents: pairs of value 0
        assert sorted(map(tuple, divergence.audit(frame(spark, few)).collect())) == self.brute(few)

    def test_shares_of_large_counts_are_exact(self, spark):
        cases = [(10**12, 3 * 10**12 + 1, 77), (0, 0, 1), (5, 5, 3), (10**14, 10**14, 10**6)]
        made = spark.createDataFrame(cases, "c long, n long, v long").select(divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
        assert [r.p for r in made] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]

    def test_hashes_that_agree(self, monkeypatch):
        """Terms whose first hashes agree are told apart by the second."""
        import pyarrow as pa

        real = divergence.tb.word_hashes
        monkeypatch.setattr(divergence.tb, "mix", lambda x: np.zeros_like(x) if x.dtype == np.uint64 else x)
        monkeypatch.setattr(divergence.tb, "word_hashes", lambda data, a, b: np.array([hash(bytes(data[i:j])) & 0xFFFF for i, j in zip(a, b, strict=True)], np.uint64))
        batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["s", "t"]), pa.array(["a b a", "b a c"])], names=["lang", "source", "text"])
        got = sorted(tuple(r.values()) for b in divergence._term_rows([batch]) for r in b.to_pylist())
        assert got == [("en", "s", "a", 1, 2), ("en", "s", "b", 1, 1), ("en", "t", "a", 1, 1), ("en", "t", "b", 1, 1), ("en", "t", "c", 1, 1)]
        assert real is not None


class TestShards:
    def check(self, docs, shards, near):
        rows = sharding.shard(docs, shards).collect()
        by = defaultdict(list)
        for r in rows:
            assert r.size == len((r.text or "").encode()) + 16
            by[r.shard].append(r)
        assert set(by) <= set(range(shards))
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
        loads = [sum(r.size for r in by[k]) for k in range(shards)]
        assert max(loads) - min(loads) <= near, loads
        return rows, loads

    def test_sizes_slots_and_neighbours(self, spark):
        rng = np.random.default_rng(1)
        texts = ["x" * int(n) + str(i) for i, n in enumerate(np.exp(rng.uniform(0, 8, 800)))]
        texts += ["same text here"] * 400 + [None, "", "", "ü你" * 30]
        docs = frame(spark, [(t, "en", "s") for t in texts]).withColumns({"slot": F.lit("clash"), "first": F.lit(1), "group": F.lit(2), "part": F.lit(3)})
        rows, loads = self.check(docs.repartition(5), 16, 120)
        assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and rows[0]["part"] == 3
        placed = defaultdict(set)
        for r in rows:
            placed[r.text].add(r.shard)
        hot = placed["same text here"]  # a third of the rows: neighbouring shards
        assert hot == set(range(min(hot), max(hot) + 1))
        assert sum(len(s) > 1 for s in placed.values()) <= 16

    def test_rows_that_are_all_the_same(self, spark):
        """A third of all rows agree in every column; a share of them goes to each side of a boundary."""
        docs = frame(spark, [(f"text {i}", "en", "s") for i in range(800)])
        same = docs.where("doc_id = 7").crossJoin(spark.range(400).select()).drop("id")
        rows, _ = self.check(docs.unionByName(same), 8, 1200)
        assert len(rows) == 1200

    def test_several_partitions_a_shard(self, spark, monkeypatch):
        monkeypatch.setattr(sharding, "PART_BYTES", 1000)
        rows, _ = self.check(frame(spark, [(f"text {i}" * (1 + i % 7), "en", "s") for i in range(500)]), 4, 60)
        assert len(rows) == 500

    def test_odd_tables(self, spark):
        assert sharding.shard(no_rows(spark), 40).count() == 0
        rows, _ = self.check(frame(spark, [("x" * 50000, "en", "s"), ("a", "en", "s"), (None, None, None)]), 4, 50016)
        assert len(rows) == 3

    def test_boundaries_are_exact(self, spark):
        rng = np.random.default_rng(5)
        keys = [(int(a), int(b), int(s)) for a, b, s in zip(rng.integers(-5, 5, 300), rng.integers(-(1 << 62), 1 << 62, 300), rng.integers(1, 9, 300), strict=True)]
        rows = spark.createDataFrame(keys, "first long, second long, size long")
        total = sum(k[2] for k in keys)
        targets = [total * k / 20 for k in range(21)]
        for target, cut in zip(targets, sharding.splitters(rows, targets, 0.0), strict=True):
            below = sum(s for a, b, s in keys if (a, b) < (cut.first, cut.second))
            assert below == cut.below and abs(below - target) <= 4.5 and not cut.share

    def test_filling(self):
        assert sharding.fill(np.array([5.0, 1.0, 0.0]), 3.0).tolist() == [0.0, 1.0, 2.0]
        assert sharding.fill(np.array([5.0, 1.0, 0.0]), 12.0).tolist() == [1.0, 5.0, 6.0]

    def test_query(self, spark, tmp_path):
        docs = frame(spark, [(f"größe {i}", "en", "s") for i in range(200)] + [(None, "en", "s")])
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        rows = queries.op12_sharding(spark, str(tmp_path)).collect()
        assert {r.doc_id: r.text_crc32 for r in rows} == {i: zlib.crc32(f"größe {i}".encode()) for i in range(200)} | {200: 0}
        assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r.shard for r in rows} == set(range(40))


class TestWhitening:
    def brute(self, vectors):
        x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
        n, sums = len(x), x.sum(axis=0)
        y = x - sums / n
        values, turn = np.linalg.eigh(y.T @ y / n)
        return ((n * x - sums) ** 2).sum(axis=1), y @ turn[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), values[::-1]

    def write(self, spark, tmp_path, vectors, kind="float"):
        rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, label int")
        rows.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
        return rows

    @pytest.mark.parametrize("d", [3, 40, 150])
    def test_query_against_eigenvectors(self, spark, tmp_path, d):
        rng = np.random.default_rng(d)
        vectors = rng.standard_normal((400, d)).astype(np.float32) * 0.1 + rng.standard_normal(d).astype(np.float32) * 0.05
        vectors[100:250] = vectors[0]  # one very common vector
        odd = [None, [], [None] * d, [float("nan")] * d, [1.0] * (d - 1) + [float("inf")], [1.0] * (d + 1), [1e38] * d]
        self.write(spark, tmp_path, [[float(c) for c in v] for v in vectors] + odd)
        rows = queries.op13_whitening(spark, str(tmp_path)).collect()
        deviation, whitened, values = self.brute(vectors)
        k = min(8, d)
        assert len(rows) == 400 * k and {r.n for r in rows} == {400}
        got = np.zeros((400, k))
        for r in rows:
            got[r.vec_id, r.component - 1] = r.whitened
            assert r.deviation == deviation[r.vec_id] and abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 and r.identity_error <= 1e-9
        for j in range(k):
            sign = np.sign((got[:, j] * whitened[:, j]).sum())
            assert np.abs(got[:, j] - sign * whitened[:, j]).max() < 1e-7

    def test_products_alone_find_the_components(self, spark):
        """Of 300 dimensions, a few passes over blocks suffice where some directions stand out; residuals certify them."""
        rng = np.random.default_rng(0)
        scale = np.concatenate([[9, 8, 7, 6, 5, 4, 3, 2.5], np.full(292, 0.1)])
        vectors = rng.standard_normal((500, 300)) * scale
        rows = spark.createDataFrame([([float(c) for c in v],) for v in vectors], "embedding array<double>")
        model = whitening.fit(rows, 8)
        assert model.passes < 9 and (model.residuals <= whitening.RESIDUAL).all()
        assert np.allclose(model.values, self.brute(vectors)[2][:8], rtol=1e-12)

    def test_odd_tables(self, spark, tmp_path):
        self.write(spark, tmp_path, [None, []])
        assert queries.op13_whitening(spark, str(tmp_path)).count() == 0
        flat = spark.createDataFrame([(i, [1.0, 2.0 * (i % 2), 3.0], "c") for i in range(10)], "vec_id long, embedding array<float>, whitened string")
        model = whitening.fit(flat, 8)  # one direction alone varies
        assert len(model.values) == 1
        assert {round(abs(r.whitened[0]), 9) for r in whitening.whiten(flat, model).collect()} == {1.0}
        same = spark.createDataFrame([(1, [1, 2])] * 3, "vec_id long, embedding array<int>")
        still = whitening.fit(same, 8)
        assert not len(still.values) and [(r.deviation, r.whitened) for r in whitening.whiten(same, still).collect()] == [(0, [])] * 3
        assert whitening.whiten(flat, None).count() == 0


class TestArchives:
    def test_query_with_many_revisits(self, spark, tmp_path):
        """Over half of the pages have one payload; others are null, empty, repeated rows, or differ by their ends alone."""
        rng = np.random.default_rng(8)
        hot = "<html>é" + "x" * 300
        pages = [(i, f"http://h/{i % 7}", hot) for i in rng.permutation(6000)[:2500].tolist()]
        pages += [(10000 + i, None, f"<p>{i % 400}</p>") for i in range(1500)]
        pages += [(20000 + i, "u", None if i % 2 else "") for i in range(300)] + [(30000 + i, "u", hot + " " * i) for i in range(1, 40)] + pages[:60]
        spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8).write.parquet(str(tmp_path / "pages.parquet"))
        newest: dict = {}
        for page, _, html in pages:
            newest[html or ""] = max(page, newest.get(html or "", page))
        digest = {h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in newest}
        expected = []
        for page, _, html in pages:
            own = html or ""
            refers = None if newest[own] == page else newest[own]
            expected.append((page, len(own.encode()), digest[own], "response" if refers is None else "revisit", refers))
        columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        found = [tuple(r) for r in queries.op3_warc(spark, str(tmp_path)).select(*columns).collect()]
        assert Counter(found) == Counter(expected)
        assert sum(r[3] == "revisit" for r in expected) > 3500


class TestLongTexts:
    def test_hits_at_both_ends(self, spark, tmp_path):
        """Benchmark items at the first and last words of texts of 60,000 words, and none in between."""
        item = [f"w{i}x" for i in range(10)]
        first, last = " ".join(f"a{w}" for w in item), " ".join(f"b{w}" for w in item)
        filler = " ".join(f"f{i % 997} g{i % 991}" for i in range(30000))
        texts = [f"{first} {filler} {last}", f"{filler} {last.upper()}", filler, f"{first}-{filler}", None, f"{' '.join(first.split()[1:])} {filler} {first}"]
        frame(spark, [(t, "en", "s") for t in texts]).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(1, first), (20, last), (3, None), (4, "absent " * 12)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        found = {r.doc_id: r for r in queries.op10_decontamination(spark, str(tmp_path)).collect()}
        sha = lambda *items: hashlib.sha256(",".join(items).encode()).hexdigest()
        expected = {0: (60020, 20, 2, sha("1", "20")), 1: (60010, 10, 1, sha("20")), 2: (60000, 0, 0, sha()), 3: (60010, 10, 1, sha("1")), 4: (0, 0, 0, sha()), 5: (60019, 10, 1, sha("1"))}
        assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for i, r in found.items()} == expected
        assert all(r.contaminated == (r.n_hit > 0) for r in found.values())
