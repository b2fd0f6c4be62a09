"""op2, op7, op8 and op9 against brute force and round trips."""

import hashlib
import re
import string
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexloom.llm import media, minhash, packing, secret_scan
from vertexloom.llm.textvec import Words, words_of

from .test_vectors_and_shards import components


# --- media -------------------------------------------------------------------
@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=30_000))
def test_chunks_join_up(data):
    ends = media.cuts(data)
    assert (ends[-1] if ends else 0) == len(data)
    sizes = np.diff([0, *ends])
    assert (sizes <= 8192).all() and (sizes[:-1] >= 256).all()
    digests, parts = media.chunk_list(data)
    form = media.stored_form(digests, list(map(len, parts)))
    assert media.rebuild(form, dict(zip(digests, parts)).get) == data


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    tail = rng.bytes(60_000)
    a, b = (set(media.chunk_list(head + tail)[0]) for head in (rng.bytes(5000), rng.bytes(7777)))
    assert len(a & b) > 20  # an inserted head moves every byte, and few chunks
    with pytest.raises(ValueError):
        media.rebuild(media.stored_form([b"\0" * 32], [1]), {}.get)


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_media_facts(spark, sf, odd, broadcast_rows):
    docs = odd.select("doc_id", "text", "key", "size").unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(80), allowMissingColumns=True)
    rows = media.media_facts(docs, broadcast_rows=broadcast_rows).collect()
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((r["doc_id"] or -1, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((r["doc_id"] or -1, *r[1:5]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    stored = media.store_media(docs)
    chunks = stored["chunks"].collect()
    assert len({bytes(c["digest"]) for c in chunks}) == len(chunks)
    assert all(hashlib.sha256(bytes(c["bytes"])).digest() == bytes(c["digest"]) for c in chunks)
    assert media.media_facts(docs.where("false")).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_every_document_is_rebuilt_from_the_tables(spark, sf, odd, broadcast_rows):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80))
    stored = media.store_media(docs, broadcast_rows=broadcast_rows)
    common = {bytes(r["digest"]): bytes(r["bytes"]) for r in stored["chunks"].collect()}
    got = []
    for r in stored["rows"].collect():
        own = {bytes(c["digest"]): bytes(c["bytes"]) for c in r["own"]}
        assert not own.keys() & common.keys() and {bytes(d) for d in r["refs"] or ()} <= common.keys()
        assert bytes(r["sha"]) == hashlib.sha256(bytes(r["form"])).digest()
        got.append((r["doc_id"] or -1, media.rebuild(bytes(r["form"]), (common | own).get)[: r["n_bytes"]]))
    assert sorted(got) == sorted((r["doc_id"] or -1, (r["text"] or "").encode()) for r in docs.collect())


# --- secrets -------------------------------------------------------------------
def brute_base(text):
    found = []
    for kind, pattern, ok in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        lowered = re.sub("(password|passwd|secret|token|api_?key)", lambda m: m[0].lower(), text, flags=re.I | re.A) if kind == "assign" else text
        found += [(kind, *m.span()) for m in re.finditer(pattern, lowered) if ok(m)]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Password", "API_KEY", "apikey", " ", ":", "=", '"', "'", "AKIA", "ABCD1234", "deadbeef", "0123456789", "é", "x.y", "\n"]), max_size=25).map("".join))
def test_base_spans(text):
    assert secret_scan.base_spans(text) == brute_base(text)
    assert set(secret_scan.base_spans(text)) <= set(secret_scan.all_spans(text)[1])


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefABCDEF0123456789-_ ", max_size=120), st.sampled_from(list(secret_scan.CLASSES.values())))
def test_entropy_windows(text, kind):
    chars, width, least = kind
    want = set()
    for at in range(len(text) - width + 1):
        window = text[at : at + width]
        if set(window) <= chars:
            p = np.array(list(Counter(window).values())) / width
            if -(p * np.log2(p)).sum() >= least - 1e-9:
                want |= set(range(at, at + width))
    assert {i for lo, hi in secret_scan.high_windows(text, *kind) for i in range(lo, hi)} == want


@pytest.mark.parametrize("alphabet, size", [(string.ascii_letters + string.digits + "-_", 22), (string.ascii_lowercase + string.digits, 24), (string.ascii_lowercase + string.digits, 20), (string.ascii_uppercase + "234567", 24), (string.ascii_uppercase + "234567", 32)])
def test_random_keys_of_every_alphabet_are_found(alphabet, size):
    rng = np.random.default_rng(5)
    keys = ["".join(rng.choice(list(alphabet), size)) for _ in range(500)]
    assert sum(secret_scan.entropy_spans(f"a {k} b") != [] for k in keys) >= 0.97 * len(keys)
    assert sum(secret_scan.entropy_spans(f"a example_{k} b") != [] for k in keys) >= 0.97 * len(keys)


def test_words_and_fillers_are_no_secrets():
    for text in ("internationalizationofthings", "example-key-placeholder-value", "ExampleExampleExampleExample", "chapter-internationalization-of-things-12", "123e4567-e89b-12d3-a456-426614174000"):
        assert secret_scan.entropy_spans(text) == [], text


def test_secret_scan(spark, sf, odd):
    found = "see wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY2 and 123e4567-e89b-12d3-a456-426614174000"
    assert secret_scan.joined(secret_scan.all_spans(found)[1]).startswith("entropy:4:")
    assert secret_scan.all_spans("AVeryLongCamelCaseWordWithoutDigits/and/plain/path-words")[0] == []
    assert secret_scan.redacted("a token=abcdefghijklmnop b") == "a [secret] b"
    rows = {r["doc_id"]: r for r in secret_scan.find_secrets(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = brute_base(r["text"])
        got = rows[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (got["n_assign"], got["n_access"], got["n_hex"]) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
    assert secret_scan.find_secrets(odd).count() == odd.count() and secret_scan.find_secrets(odd.where("false")).count() == 0


# --- near duplicates -------------------------------------------------------------
def sets_of(text):
    w = words_of(text).split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_jp(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a.keys() & b.keys())


def test_prob_jaccard_and_estimate():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcd"), 60)) for _ in range(6)] + ["a b", "one two three four five"]
    sets = Words([words_of(t) for t in texts]).shingles(5)
    signatures = minhash.prob_minhash(sets, 4096)
    for i, j in combinations(range(len(texts)), 2):
        want = brute_jp(sets_of(texts[i]), sets_of(texts[j]))
        assert minhash.prob_jaccard(sets[i], sets[j]) == pytest.approx(want)
        assert (signatures[i] == signatures[j]).mean() == pytest.approx(want, abs=0.05)
    alone = minhash.prob_minhash([sets[0]], 4096)
    assert (alone[0] == signatures[0]).all()  # the batch does not matter


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 200))))
        for c in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy) if c % 5 else " ".join(base).upper())
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, block=4).collect()}
    sets = [sets_of(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if brute_jp(sets[i], sets[j]) >= 0.8]
    part = components(len(texts), links)
    assert [got[i * 3] for i in range(len(texts))] == [3 * p for p in part]


def test_near_duplicates_odd_rows(spark, odd):
    rows = sorted(((r["doc_id"] or -1), r["class_id"] or -1, r["kept"]) for r in minhash.near_duplicates(odd).collect())
    assert rows == [(-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True)]
    kept = minhash.keep_one(odd, minhash.near_duplicates(odd))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7]
    assert minhash.near_duplicates(odd.where("false")).count() == 0
    assert minhash.keep_one(odd.where("false"), minhash.near_duplicates(odd.where("false"))).count() == 0


def brute_classes(rows):
    """Rows (doc_id, text) by their class, and the row that each class keeps."""
    sets = [sets_of(t or "") for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and (sets[i] == sets[j] or brute_jp(sets[i], sets[j]) >= 0.8)]
    part, classes = components(len(rows), links), {}
    for i, p in enumerate(part):
        classes.setdefault(p, []).append(rows[i])
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    return [(min(c, key=order), c) for c in classes.values()]


def test_repeated_and_null_ids_lose_no_document(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t: t.replace(t.split()[0], "zz", 1)
    rows = [(3, a), (5, a), (5, b), (5, c), (5, near(c)), (3, b.upper()), (9, d), (9, d), (9, d + " "), (None, d), (None, near(a)), (None, c + " x"), (None, " ".join(reversed(a.split()))), (None, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    classes = minhash.near_duplicates(df, hot=1)
    want = brute_classes(rows)
    told = sorted((r["doc_id"] or -1, bytes(r["digest"] or b""), r["class_id"] or -1, r["kept"]) for r in classes.collect())
    digest = lambda t: hashlib.md5(t.encode()).digest() if t is not None else b""
    assert told == sorted((i or -1, digest(t), first[0] or -1, (i, t) == first) for first, c in want for i, t in c)
    for broadcast_ids in (0, 1000):
        kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one(df, classes, broadcast_ids=broadcast_ids).collect()]
        assert sorted(kept, key=repr) == sorted({first for first, _ in want}, key=repr)


def test_near_duplicates_of_the_documents_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    sets = {d: sets_of(t) for d, t in texts.items()}
    holders = {}
    for d, s in sets.items():
        for e in s:
            holders.setdefault(e, []).append(d)
    shared = Counter(p for held in holders.values() if len(held) < 200 for p in combinations(sorted(held), 2))
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.5 * min(len(sets[a]), len(sets[b])) and brute_jp(sets[a], sets[b]) >= 0.8]
    assert len(links) > 50
    place = {d: i for i, d in enumerate(sorted(texts))}
    part = components(len(place), [(place[a], place[b]) for a, b in links])
    assert [got[d] for d in sorted(texts)] == [sorted(texts)[p] for p in part]


def test_long_texts_have_the_signature_of_their_parts():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 2**63, 3 * minhash.ARRIVING // 2).astype(np.uint64))
    weights = rng.integers(1, 4, len(hashes))
    whole = minhash.prob_minhash([(hashes[:9], weights[:9]), (hashes, weights), (hashes[9:40], weights[9:40])], 64)
    n, minhash.ARRIVING = minhash.ARRIVING, 1 << 20
    try:
        assert (whole == minhash.prob_minhash([(hashes[:9], weights[:9]), (hashes, weights), (hashes[9:40], weights[9:40])], 64)).all()
    finally:
        minhash.ARRIVING = n
    text = " ".join(f"word{i % 99991}" for i in range(60_000))
    assert words_of(text + " \x1c\u3000 x\n") == " ".join((text + " x").split())
    w = Words([text, "", "a b"])
    assert w.counts.tolist() == [60_000, 0, 2] and w.hashes[:3].tolist() == Words(["word0 word1 word2"]).hashes.tolist()
    assert sum(len(h) for h, _ in w.grams(3)) == sum(map(len, text.split())) + 2


# --- packing ----------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_decreasing(lengths):
    window, offset = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(64 - n)
    assert len(set(window)) == len(rooms)
    held = {}
    for w, o, n in zip(window, offset, lengths):
        held.setdefault(w, []).append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(None)
    for text in ["", " ", "a  b\n\n c\t", "Größe 1,234.5 it's　x", "<|endoftext|> a", "​퟿😀 é", "  lead", "trail  \n"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_packing(spark, odd):
    encode = packing.encoder(None)
    for stretch in (None, "source"):
        rows = packing.pack_documents(odd, size=256, stretch=stretch, group_rows=5).collect()
        want = Counter()
        for r in odd.collect():
            ids = np.append(np.frombuffer(encode(r["text"] or ""), "<u4"), 1).astype("<u4")
            for at in range(0, len(ids), 256):
                want[r["doc_id"], at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()), len(ids)] += 1
        assert Counter(tuple(r)[:5] for r in rows) == want
        held = {}
        for r in rows:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in held.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert packing.pack_documents(odd.where("false")).count() == 0
