"""op4, op5, op6, op10 and the pipeline."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vertexloom.llm import catalog, minhash, mixing, quality, secret_scan, toxicity, url_filter
from vertexloom.llm.shared import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, sf, least, recall, precision", [("op10_quality", "quality", SF, 0.95, 0.95, 0.95), ("op4_toxicity", "toxic", "/root/testdata/sf0.1", 0.96, 0.85, 0.82)])
def test_held_out(spark, name, label, sf, least, recall, precision):
    got = catalog.QUERIES[name](spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").select("predicted", label, "score").toPandas()
    assert len(got) > 50 and (got.predicted == got[label]).mean() >= least
    both = ((got.predicted == 1) & (got[label] == 1)).sum()
    assert both >= recall * (got[label] == 1).sum() and both >= precision * (got.predicted == 1).sum()
    assert got.score.between(0, 1).all() and got[got[label] == 1].score.mean() > got[got[label] == 0].score.mean()


def test_models_odd_rows(odd, labels):
    for f in (quality.score_quality, toxicity.score_toxicity):
        rows = f(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["score"] == 0.5 for r in f(odd, labels.where("false")).collect())
        assert f(odd.where("false"), labels).count() == 0


def test_labels_take_turns_in_a_sample(spark):
    n = 400
    docs = spark.range(n).selectExpr("id as doc_id", "repeat('w ', int(id % 7) + 1) as text")
    marks = spark.range(n).selectExpr("id as doc_id", "int(id % 10 = 0) as toxic")
    usable = marks.where(~quality.held_out(F.col("doc_id")))
    rare = usable.where("toxic = 1").count()
    few, many = (quality.labelled_sample(docs, marks, "toxic", rows, 10**6, alike=True).orderBy("place").toPandas() for rows in (20, 200))
    assert list(few.y) == [1, 0] * 10
    assert len(many) == 200 and many.y.sum() == rare  # what a rare label lacks, the other fills
    whole = quality.labelled_sample(docs, marks, "toxic", n, 10**6, alike=True)
    assert whole.count() == usable.count()
    assert quality.labelled_sample(docs, marks, "toxic", n, 50, alike=True).agg(F.sum(F.length("text"))).first()[0] <= 50


def test_scores_do_not_depend_on_the_batch():
    texts = ["one two three", None, "", "a " * 500, "x y"]
    sample = pd.DataFrame({"text": ["good words here"] * 30 + ["bad bad bad"] * 30, "y": [1] * 30 + [0] * 30})
    for score in (lambda t, m=quality.train(sample): quality.scores(t, *m), lambda t, m=toxicity.train(sample, epochs=2): toxicity.scores(m, t)):
        assert score(texts) == pytest.approx([score([t])[0] for t in texts], abs=1e-6)


def test_quality_scores_are_those_of_a_plain_scorer():
    """One loop per feature, on hashes of single words and grams."""
    from vertexloom.llm.textvec import U, Words, mix

    rng = np.random.default_rng(6)
    table = np.round(rng.normal(size=quality.BUCKETS) * quality.GRAIN) / quality.GRAIN
    for text in ("", "one", "ab cd ab cd  ab\n", "naïve x naïve " + "long " * 12, None):
        words = (text or "").split()
        hashes = [int(Words([w]).hashes[0]) for w in words]
        found = [h % quality.BUCKETS for h in hashes]
        for w in words:
            for n in quality.GRAMS:
                found += [int(h) % quality.BUCKETS for part, _ in Words([w]).grams(n) for h in part]
        for back in quality.REPEATS:
            found += [int(mix(np.array([2 * back + (hashes[i] == hashes[i - back])], U))[0]) % quality.BUCKETS for i in range(back, len(words))]
        want = 1 / (1 + np.exp(-(sum(table[b] for b in found) / max(1, len(found)) + 0.25)))
        assert quality.scores([text], table, 0.25)[0] == pytest.approx(want, abs=1e-12)


def test_toxicity_scores_are_those_of_a_plain_scorer(monkeypatch):
    """Each window alone, step by step; and pieces of a long text score as the whole."""
    sample = pd.DataFrame({"text": [f"good words here {i}" for i in range(30)] + [f"bad bad you {i}" for i in range(30)], "y": [1] * 30 + [0] * 30})
    model = toxicity.train(sample, epochs=2)
    sigma, h = lambda v: 1 / (1 + np.exp(-v)), toxicity.HIDDEN
    for text in ("", "good", "bad words " * 40, " ".join(f"w{i} bad" for i in range(57))):
        words, logits = text.split(), []
        starts = range(0, max(1, len(words) - toxicity.WIDTH + toxicity.STEP), toxicity.STEP)
        for begin in starts:
            part = words[begin : begin + toxicity.WIDTH]
            x = [toxicity.Tokens([w], model["vocabulary"]).inputs(model, 0, 1)[0] for w in part]
            sides = {}
            for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
                cur, sides[side] = np.zeros(h), [None] * len(x)
                for t in order:
                    g, u = x[t] @ model[f"W{side}"] + model[f"b{side}"], model[f"U{side}"]
                    z, r = sigma(g[:h] + cur @ u[:, :h]), sigma(g[h : 2 * h] + cur @ u[:, h : 2 * h])
                    cur = (1 - z) * cur + z * np.tanh(g[2 * h :] + (r * cur) @ u[:, 2 * h :])
                    sides[side][t] = cur
            states = [np.concatenate([f, b]) for f, b in zip(sides["f"], sides["b"])]
            weight = np.exp([s @ model["a"] for s in states]) if states else np.zeros(0)
            pooled = sum((w / weight.sum() * s for w, s in zip(weight, states)), np.zeros(2 * h))
            logits.append(float(pooled @ model["o"] + model["c"][0]))
        top = sorted(np.clip(logits, -toxicity.CAP, toxicity.CAP), reverse=True)
        want = sigma(sum(model["top"][i] * top[min(k, len(top) - 1)] for i, k in enumerate((0, 2, 4))) + model["top"][3])
        assert toxicity.scores(model, [text])[0] == pytest.approx(want, abs=1e-4)
    long = [" ".join(f"word{i % 91} bad{i % 7}" for i in range(n)) for n in (3000, 3001, 3007, 3008)] + ["x" * 9000 + " y" * 50]
    whole = toxicity.scores(model, long)
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert toxicity.scores(model, long) == pytest.approx(whole, abs=1e-6)
    parts = list(toxicity.pieces(long[0]))
    assert len(parts) > 5 and sum(len(toxicity.Tokens([p], model["vocabulary"]).windows()[0]) for p in parts) == len(toxicity.Tokens([long[0]], model["vocabulary"]).windows()[0])


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    model = toxicity.fresh_model(1, np.zeros(0, np.uint64))
    model = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in model.items()}
    x = rng.normal(size=(9, toxicity.DIM_WORD + toxicity.DIM_CHAR))
    at, mask = rng.integers(0, 9, (3, 5)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    weight = rng.normal(size=3)
    loss = lambda: float(toxicity.forward(model, x, at, mask) @ weight)
    _, kept = toxicity.forward(model, x, at, mask, keep=True)
    grad, d_x = toxicity.backward(model, x, at, mask, kept, weight)
    for name, values, g in [(k, model[k], grad[k]) for k in grad] + [("x", x, d_x)]:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in values.shape)
            old, h = values[i], 1e-2
            values[i] = old + h
            up = loss()
            values[i] = old - h
            down = loss()
            values[i] = old
            assert g[i] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-3), name


def test_windows_cover_everything():
    tokens = toxicity.Tokens(["w " * n for n in (0, 1, 31, 32, 33, 100)], np.zeros(0, np.uint64))
    doc, first, count = tokens.windows()
    for d, n in enumerate((0, 1, 31, 32, 33, 100)):
        seen = {w for f, c in zip(first[doc == d], count[doc == d]) for w in range(f, f + c)}
        assert len(seen) == n and (doc == d).any()


# --- mixing ------------------------------------------------------------------------
@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 1}, {"a": 0.9, "b": 0.07, "c": 0.03}])
def test_period_deviates_less_than_a_block(weights):
    counts = mixing.shares(weights, 1000)
    plan, total = mixing.period(counts), sum(counts.values())
    done = dict.fromkeys(counts, 0)
    for slot, s in enumerate(plan, 1):
        done[s] += 1
        assert all(abs(done[x] - slot * counts[x] / total) < 1 for x in counts)
    assert done == counts


@pytest.mark.parametrize("weights", [dict.fromkeys("abc", 1), dict.fromkeys("abcdef", 0.1), dict.fromkeys("abcdefghijklmnopqrs", 1.0), {"a": 0.9999, "b": 0.0001}, {"a": 0.1234567, "b": 0.5, "c": 0.3765433}, {"a": 1 / 3, "b": 1 / 7, "c": 0.6}])
def test_long_schedules_follow_the_target_weights(weights):
    total = sum(map(mixing.exact, weights.values()))
    n = 40_000
    blocks = {s: max(1, int(n * mixing.exact(w) / total)) for s, w in weights.items()}
    slots = {}
    for s, phase, first, last, a, length, start, places in mixing.phases(blocks, weights):
        for k in range(last - first):
            slot = start + k // a * length + places[k % a]
            assert slot not in slots
            slots[slot] = (phase, s)
    assert sorted(slots) == list(range(sum(blocks.values())))
    done = dict.fromkeys(weights, 0)
    for slot in range(len(slots)):
        if slots[slot][0]:
            break
        done[slots[slot][1]] += 1
        assert all(abs(done[s] - (slot + 1) * float(mixing.exact(w) / total)) < 1 + 1e-9 for s, w in weights.items())
    assert slot > n / 2


def test_slots_are_those_of_a_plain_earliest_deadline_first():
    rng = np.random.default_rng(8)
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}, {"a": 1 / 3, "b": 0.123, "c": 0.5, None: 0.01}, mixing.TARGETS):
        given = {s: mixing.exact(w) for s, w in weights.items()}
        blocks = {s: int(rng.integers(1, 120)) for s in weights}
        got = {}
        for s, _, first, last, a, length, start, places in mixing.phases(blocks, given):
            got |= {start + k // a * length + places[k % a]: s for k in range(last - first)}
        left, want = dict(blocks), []
        while left:  # a phase: until a source runs out
            total, done, slot = sum(given[s] for s in left), dict.fromkeys(left, 0), 0
            while all(done[s] < left[s] for s in left):
                released = [s for s in left if done[s] * total // given[s] <= slot]
                s = min(released, key=lambda s: (-(-(done[s] + 1) * total // given[s]), s is None, s or ""))
                assert slot < -(-(done[s] + 1) * total // given[s])  # before its deadline
                want.append(s)
                done[s] += 1
                slot += 1
            left = {s: n - done[s] for s, n in left.items() if n > done[s]}
        assert [got[i] for i in range(len(got))] == want


def test_mix(spark, odd):
    rows = [(i, f"t{i}", s) for s, n in (("a", 300), ("b", 90), ("c", 40), (None, 33)) for i in range(n)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _sub int, _key int")
    got = mixing.mix_sources(df, weights={"a": 0.5, "b": 0.3}, block=8).toPandas()
    assert list(got.columns) == [*df.columns, "block", "slot", "position"] and len(got) == len(rows)
    assert got.position.is_unique and (got.position // 8 == got.slot).all()
    slots = got.drop_duplicates("slot").sort_values("slot")
    assert slots.slot.tolist() == list(range(len(slots)))
    assert got.groupby("slot").source.nunique(dropna=False).max() == 1
    for s, part in slots.groupby("source", dropna=False):
        assert part.block.tolist() == list(range(len(part)))
    want = {"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1}
    lasting = min(part.slot.max() for _, part in slots.groupby("source", dropna=False))
    for n in range(1, lasting + 1):
        head = slots[slots.slot < n].source
        assert all(abs((head.isna() if s is None else head == s).sum() - n * w) < 1 + 1e-9 for s, w in want.items())
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, weights={"a": 0})


# --- urls -------------------------------------------------------------------------
def test_url_rules(spark, labels):
    urls = ["http://Example.COM/en/7x?q", "https://a.b.example.com/en/8", "ftp://other.com/en/", "http://notexample.net/de/8", "http://x.example.net/de/80#f", "http://q.org/es/", "http://com/en/1", "nothing", None, "", "http://h?x/en/", "://", "http://www.shop.co.uk/a/1"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels).collect()}
    assert [got[i]["rule"] for i in range(13)] == ["example.com/en/7", "com/en/", "com/en/", "net/de/", "example.net/de/8", "org/es/", "com/en/", None, None, None, None, None, None]
    assert [got[i]["verdict"] for i in range(7)] == ["allow", "block", "block", "allow", "block", "block", "block"]
    assert (got[7]["host"], got[8]["path"], got[10]["host"], got[10]["path"], got[0]["host"]) == ("", "", "h", "", "example.com")
    assert url_filter.judge_urls(pages, labels.where("false")).count() == 13 and url_filter.judge_urls(pages.where("false"), labels).count() == 0


def test_long_and_slashed_urls(spark):
    deep = "http://deep.com/" + "a/" * 100_000 + "5"
    urls = [deep, deep + "/?q#f", "http://x.com/7/", "http://x.com/7//", "http://x.com/a7", "http://x.com/12x?8", "http://x.com/#9", "http://x.com/" + "9" * 40, "http://x.com", "http://x.com/3\n", "x/4", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(url_filter.named_document(url_filter.host_and_path(df["url"])[1])).collect()]
    assert got == [5, 5, 7, None, None, 12, None, int("9" * 18), None, 3, None, None]


def test_a_hot_host_is_dealt_out(spark):
    pages = spark.createDataFrame([(i, f"http://{'hot' if i % 3 else f'h{i}'}.com/d/{i}", i % 2) for i in range(400)], "page_id long, url string, host int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    plain, dealt = (sorted(map(tuple, url_filter.judge_urls(pages, labels, hot=hot).collect())) for hot in (1000, 10))
    assert plain == dealt and len(plain) == 400


def test_urls_match_sql(spark):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    result = con.execute(url_filter.SQL)
    names = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in catalog.QUERIES["op6_url_reputation"](spark, SF).collect()) == want


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://{'bad' if i < 300 else 'good'}.site.com/d/{i}") for i in range(600)] + [(600, "http://new.site.com/d/9999"), (601, "http://one.bad.io/d/0")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 300)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels).collect()}
    assert got[0]["verdict"] == "block" and got[400]["verdict"] == "allow"
    assert got[0]["bad_rate"] > 0.95 > 0.05 > got[400]["bad_rate"] and 0.2 < got[600]["bad_rate"] < 0.8
    assert got[601]["verdict"] == "allow"  # one outcome is not enough


# --- pipeline ---------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    docs, seen = table(spark, SF, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        seen.append((docs, docs := spark.read.parquet(f"{tmp_path}/{i}")))
    columns = table(spark, SF, "documents").columns
    assert all(after.columns == columns for _, after in seen[:4])
    (first, good), (_, unique), (_, clean), (_, mixed), (_, packed) = seen
    score = {r["doc_id"]: r["predicted"] for r in quality.score_quality(first, table(spark, SF, "labels")).collect()}
    assert sorted(r["doc_id"] for r in good.select("doc_id").collect()) == sorted(d for d, p in score.items() if p)
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(good).collect()}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(set(classes.values()))
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert all(r["text"] == secret_scan.redacted(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in clean.collect())
    order = {r["doc_id"]: r["position"] for r in mixing.mix_sources(clean, weights=mixing.TARGETS).collect()}
    read = [order[r["doc_id"]] for r in mixed.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    assert read == sorted(order.values())
    lengths = {}
    for r in packed.collect():
        lengths.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(lengths) == set(order)
    for parts in lengths.values():
        parts.sort()
        assert sum(n for _, n, _ in parts) == parts[0][2]


@pytest.mark.parametrize("files", [1, 7])
def test_packed_sequences_follow_the_mix(spark, tmp_path, files):
    rows = [(i, f"document {i} " + "word " * (i * 37 % 200), f"s{i % 4}" if i < 8000 else "hot", "en", 1) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    order = {r["doc_id"]: r["position"] for r in mixing.mix_sources(docs).collect()}
    mixed = corpus_pipeline.mixed(spark, docs, SF)
    mixed.coalesce(1).write.parquet(f"{tmp_path}/1") if files == 1 else mixed.write.option("maxRecordsPerFile", 12_000 // files).parquet(f"{tmp_path}/{files}")
    got = corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/{files}"), SF).toPandas().sort_values("sequence_id")
    rank = {d: i // (corpus_pipeline.STRETCH_SLOTS * mixing.BLOCK) for i, d in enumerate(sorted(order, key=order.get))}
    stretches = got.doc_id.map(rank)
    assert set(got.doc_id) == set(order) and stretches.is_monotonic_increasing and stretches.nunique() == 12
    assert got.assign(stretch=stretches).groupby("sequence_id").stretch.nunique().max() == 1
    for n in range(1, 9):  # while all five sources last, each has a fifth of every prefix
        head = got[stretches < n].doc_id.drop_duplicates().map(lambda d: rows[d][2]).value_counts()
        assert all(abs(c - n * 1024 / 5) <= 64 for c in head) and len(head) == 5


def test_stages_take_odd_rows(spark, odd, tmp_path):
    for docs, want in ((odd, odd.collect()), (odd.where("false"), [])):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)  # on a frame that no file backs
            rows = out.collect()
            if i < 4:
                assert out.columns == docs.columns
            if i in (2, 3):
                assert len(rows) == len(want)
            if i == 2:
                assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in rows) == sorted((r["doc_id"] or -1, len(r["text"]) if r["text"] is not None else r["n_chars"]) for r in want)
            if i == 4:
                assert sorted({r["doc_id"] or -1 for r in rows}) == sorted({r["doc_id"] or -1 for r in want}) and sum(r["start"] == 0 for r in rows) == len(want)


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and rows.columns[:3] == ["doc_id", "start", "length"]
