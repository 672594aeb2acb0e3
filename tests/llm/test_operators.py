"""Every operator against brute force, exact round trips or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import struct
import subprocess
import sys
import tempfile
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import chat, common, langid, licenses, media, mixing, neardup, packing, pii, queries, substrings, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, t string, id string, h bigint, epoch string, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def odd(spark, texts):
    """Rows with every column null, odd texts, and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None, "t", "id", 5, "e", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t", "a", "a", "A b", "é" * 200, "x" * 5000, "word " * 3000, "\x00\x1c\x85 b", "日本語のテキスト", "same words here again " * 20, "same words here again " * 20]


# --- media ---


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("n", [64, 640, 64 * 40])
def test_png_round_trip(kind, n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    stored = media.encode_png(payload, (kind,))
    assert media.decode_png(stored).tobytes() == payload


def test_png_mixed_filters_and_checksums():
    rows = np.random.default_rng(1).integers(0, 256, (12, 64), np.uint8)
    kinds = np.array([0, 2, 1, 4, 4, 3, 2, 2, 0, 1, 3, 2])
    lines = np.stack([media.filter_rows(rows, k)[i] for i, k in enumerate(kinds)])
    assert (media.unfilter(kinds, lines) == rows).all()
    stored = bytearray(media.encode_png(bytes(640)))
    stored[-20] ^= 1
    with pytest.raises(media.MediaError):
        media.decode_png(bytes(stored))
    for cut in (0, 7, 30, len(stored) - 5):
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(stored[:cut]))


def test_media_query(spark, docs):
    extra = odd(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000)
    both = docs.unionByName(extra, allowMissingColumns=True)
    got = {r.doc_id: r for r in media.features(media.to_media(both)).collect()}
    for r in both.collect():
        data = (r.text or "").encode()
        p = media.padded(data)
        g = got[r.doc_id]
        assert len(p) % 64 == 0 and p and (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(g.feature) == 16
    assert len(got) == both.count()
    assert got[10_003].media_sha256 == got[10_004].media_sha256 and got[10_003].feature == got[10_004].feature


# --- personal data ---


def slow_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_match_the_plain_rules():
    rng = random.Random(3)
    alphabet = "0123456789.@+-() aB_%é\n"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == slow_spans(text), text
    text = "1" * 50_000 + "a" * 50_000 + "@" + "1.2.3." * 5000 + "+" * 5000
    pii.base_spans(text)  # linear


def test_tagger_on_held_out_windows():
    model = pii.trained()
    texts, labels = pii.labelled_windows(400, 12345)
    ids = np.stack([pii._filled(pii.char_ids(t)) for t in texts])
    path = np.stack(model.viterbi(list(model.emissions(ids)[0])))
    assert (path == labels).mean() > 0.97 and (path == labels)[labels > 0].mean() > 0.9


def test_gradients():
    model = pii.Tagger(hidden=3, embed=4, seed=1)
    texts, labels = pii.labelled_windows(3, 5)
    ids = np.stack([pii._filled(pii.char_ids(t)) for t in texts])
    _, grads = model.step(ids, labels)
    for name, at in (("out", (1, 2)), ("whf", (0, 5)), ("wxb", (2, 7)), ("trans", (0, 1)), ("emb", (int(ids[0, 0]), 1)), ("bb", (3,))):
        kept = model.p[name][at]
        values = []
        for step in (1e-2, -1e-2):
            model.p[name][at] = kept + step
            values.append(model.step(ids, labels)[0])
        model.p[name][at] = kept
        assert abs((values[0] - values[1]) / 2e-2 - grads[name][at]) < 0.05 * max(1, abs(grads[name][at])), name


def test_model_adds_and_keeps():
    text = "aaa " * 40 + "call (555) 123-4567 or joe.doe [at] example [dot] com, ip 1.2.3.4, x@y.com" + " bbb" * 40
    base, all_ = pii.find([text], pii.trained())[0]
    assert [k for _, _, k in base] == [1, 0] and set(base) < set(all_)
    assert sorted(text[s:e] for s, e, _ in all_ if (s, e, _) not in base) == ["(555) 123-4567", "joe.doe [at] example [dot] com"]
    assert pii.find(["version 2.0 of 2024-01-02, password=04c2b6b343501bc0e2"], pii.trained())[0] == ([], [])


def test_long_spans_are_found_wherever_they_stand():
    model = pii.trained()
    for value in ("maria.fernandez-gonzalez (at) informatik.uni-example (dot) de", "anna.maria.lopez-hernandez.de.la.cruz-y-garcia_1987 [at] research-department.university-of-somewhere [dot] org"):
        for at in range(0, 24, 5):
            text = "x" * at + " " + "some words that stand here, " * 4 + value + " and " + "other words that follow it " * 4
            start = text.index(value)
            assert pii.find([text], model)[0][1] == [(start, start + len(value), 0)]


def test_model_on_real_texts(docs):
    """Values that no base rule finds, planted between the words of documents; the documents themselves gain next to nothing."""
    model, rng = pii.trained(), random.Random(4)
    texts = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 20][:120]
    plain = pii.find(texts, model)
    values = ["joe.doe [at] example [dot] com", "anna_k (at) post.example", "(555) 123-4567", "555-123-4567", "4111.1111.1111.1111", "2001:db8:85a3:0:0:8a2e:370:7334"]
    hit, planted = 0, []
    for t in texts:
        words, value = t.split(" "), rng.choice(values)
        at = rng.randrange(1, len(words))
        planted.append((" ".join([*words[:at], value, *words[at:]]), value))
    for (text, value), (base, all_) in zip(planted, pii.find([t for t, _ in planted], model), strict=True):
        hit += any(text[s:e] == value for s, e, _ in set(all_) - set(base))
    assert hit >= 0.9 * len(texts)
    assert sum(len(a) - len(b) for b, a in plain) <= 0.02 * len(texts)


def test_pii_query(spark, docs):
    both = docs.unionByName(odd(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000), allowMissingColumns=True)
    rows = pii.detect(both).collect()
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
    out = pii.redact(both)
    assert out.columns == both.columns and out.count() == both.count()
    assert out.filter(F.col("text").rlike(r"@mail[0-9]\.example")).count() == 0


# --- search ---


def test_topk_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 8) / 4]) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 400)]  # a large tie
    rows += [(400, None), (450, [float("nan")] * 8), (500, [None] * 8), (550, [float("inf")] * 8), (600, []), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows[:400]]
    for lists in (1, 3, 4):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, df.filter("vec_id % 50 = 0"), 5, lists).collect()}
        expect = {}
        for i, v in good:
            if i % 50 == 0:
                best = sorted((-int(v @ w), j) for j, w in good if j != i)[:5]
                expect |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
        assert got == expect
    mixed = df.unionByName(spark.createDataFrame([(i, [1.0] * (1 + i % 3)) for i in range(1000, 1050)], "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)))
    got = topk.search(mixed, mixed.filter("vec_id in (0, 1000)"), 5).collect()
    assert sorted((r.vec_id, r.score) for r in got if r.query_id == 1000) == [(i, 1 << 17) for i in range(1003, 1018, 3)]
    few = df.filter("vec_id in (0, 1, 50)")
    assert topk.search(few, few.filter("vec_id % 50 = 0"), 5).count() == 4
    assert topk.search(df.limit(0), df.limit(0), 5).count() == 0


def test_topk_cutoffs_save_most_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    q, mine, cuts = x[:80], np.arange(4000)[None] == np.arange(80)[:, None], topk.slices_of(64, 2)
    top, low = topk.gather(q, x, mine, 5, cuts)
    bound = top[:, 4]
    found = topk.collect(q, x, mine, low + ((bound - low.sum(1)) / 2)[:, None], cuts)
    assert len(found[0]) < 0.1 * mine.size and len(set(zip(found[0], found[1], strict=True))) == len(found[0])
    r, c, s = topk.resolve(q, x, found, bound, cuts)
    score = np.where(mine, -np.inf, q @ x.T)
    assert (s == score[r, c]).all() and len(r) < 0.2 * len(found[0])
    for i in range(80):
        assert set(np.argsort(-score[i], kind="stable")[:5]) <= set(c[r == i])


# --- repeated strings ---


def slow_repeats(texts, span):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i]
        cover = bytearray(len(b))
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            if w in seen:
                cover[p : p + span] = b"\1" * span
            seen.add(w)
        out[i] = (len(b), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), bytes(x for x, c in zip(b, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("block", [1 << 16, 7, 40])
def test_column_order(block, monkeypatch):
    """The files of order and common prefixes against a comparison of all strings of a column, in blocks of any size."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    rng, span, width = np.random.default_rng(block), 5, 14
    rows = [(int(rng.integers(0, 4)), bytes(rng.choice(list(b"ab"), rng.integers(1, 11)).tolist())) for _ in range(150)]
    off = np.cumsum([0, *(len(b) for _, b in rows)])
    with tempfile.TemporaryFile(buffering=0) as file:
        columns = substrings.Columns(file, width)
        columns.add(np.frombuffer(b"".join(b for _, b in rows), np.uint8), off, np.array([a for a, _ in rows]))
        assert all((columns.column(j) == [b[j - a] if a <= j < a + len(b) else 256 for a, b in rows]).all() for j in range(width))
        got = {(j, int(r)) for j, found in substrings.column_order(columns, span) for r in found}
    expect = set()
    for j in range(width - span + 1):
        seen = set()
        for r, (a, b) in enumerate(rows):
            if a <= j and len(w := b[j - a : j - a + span]) == span:
                expect |= {(j, r)} if w in seen else set()
                seen.add(w)
    assert got == expect and expect


@pytest.mark.parametrize("fragments", [100_000, 4])
def test_repeats(spark, docs, fragments, monkeypatch):
    monkeypatch.setattr(substrings, "FRAGMENTS", fragments)
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (99, 100, 101, 160, 400)]
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    for i in range(1000, 1080):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))) for _ in range(4)]
        texts[i] = "".join(parts)
    texts |= {2000 + i: t for i, t in enumerate(ODD)} | {3000: "ab" * 400, 3001: "ab" * 60 + "é" * 150}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("doc", F.lit(1)).repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect()}
    assert got == slow_repeats({i: (t or "").encode() for i, t in texts.items()}, 100)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


# --- packing ---


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    texts = [*ODD, "It's DON'T a'll 'S", "a\x85b\xa0c\x0bd", "x²y½z3 ¼12", "İSTANBUL ΣΑΣ", "<|endoftext|> hi", "café ÀÉ ª", "foo_bar--baz!!!   x.,"]
    both = docs.unionByName(odd(spark, texts).withColumn("doc_id", F.col("doc_id") + 10_000), allowMissingColumns=True).repartition(5).cache()
    pieces = packing.pack(both)
    rows, by, seq = pieces.collect(), {}, {}
    tokenizer = Tokenizer.from_file(packing.word_path())
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for r in both.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by[r.doc_id], key=lambda p: p.start):
            part = struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length])
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part) and bytes(p.ids) == part
            at += p.length
        assert at == len(ids)
    sizes = []
    for i in sorted(seq):
        at = 0
        for p in sorted(seq[i], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert sorted(seq) == list(range(len(seq))) and set(sizes[:-1]) == {2048} and 0 < sizes[-1] <= 2048
    assert {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(pieces).collect()} == dict(enumerate(sizes))
    assert packing.pack(docs.limit(0)).count() == 0


def grown(code):
    """MB by which the peak and the resident memory of a process grow while it runs code; what stands before a line of # is not counted."""
    before, after = code.split("#\n")
    status = "[int(re.search(k + r':\\s+(\\d+)', open('/proc/self/status').read())[1]) // 1024 for k in ('VmHWM', 'VmRSS')]"
    run = f"import re\n{before}x = {status}\n{after}y = {status}\nprint(y[0] - x[0], y[1] - x[1])"
    return list(map(int, subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, check=True, timeout=120).stdout.split()))


def test_packing_memory_of_whole_texts():
    code = """
from maskloom.llm import packing
encode = packing.encoder(packing.word_path())
texts = ["".join(chr(0x4E00 + (i * 7919 + j * 104729) % 20000) + " " * (j % 6 == 5) for j in range(1800)) for i in range(800)]
#
ids = encode(texts)
assert len(ids) == 800
"""
    assert grown(code)[0] < 300


def test_shingles_memory():
    """A group to confirm may have 48 MB."""
    code = """
import numpy as np
from maskloom.llm import common
raw, off = np.tile(np.frombuffer(b"some words ", np.uint8), 2_000_000), np.arange(0, 22_000_001, 11_000)
#
values, at = common.shingle_sets(raw, off, 5)
assert np.diff(at).tolist() == [2] * 2000
sig = common.minhashes(values, at, 4)
"""
    assert grown(code)[0] < 300


def test_shingles_in_blocks(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))).encode() for _ in range(200)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    want, at = common.shingle_sets(raw, off, 3)
    sig = common.minhashes(want, at, 8)
    monkeypatch.setattr(common.blocks, "__defaults__", (64,))
    got, upto = common.shingle_sets(raw, off, 3)
    assert (got == want).all() and (upto == at).all() and (common.minhashes(got, upto, 8) == sig).all()
    assert common.shingle_sets(raw[:0], off[:1], 3)[1].tolist() == [0]


def test_workers_release_memory():
    code = """
from maskloom.llm import common
def run(batches):
    held = [bytes(1000 + i % 7) for i in range(300_000)]
    last = held[-1]
    del held
    kept.append(last)
    yield from batches
kept = []
#
assert list(common.released(run)(iter([1, 2]))) == [1, 2]
"""
    peak, left = grown(code)
    assert peak > 250 and left < 100


def test_packing_store_of_units(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 1000)
    encode = packing.WordEncoder(packing.word_path())
    texts = [" ".join(f"w{i}x{j}" + "." * (j % 2) for j in range(500)) for i in range(10)]
    ids = encode(texts)
    assert [x[:-1].tolist() for x in ids] == [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(encode.known) <= 1000


# --- near-duplicates ---


def slow_groups(texts, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k,blocks", [(2, False), (5, False), (2, True)])
def test_near_duplicates(spark, k, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(neardup, "GROUP_ROWS", 8)
        monkeypatch.setattr(neardup, "LEAF", 8)
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    texts = {i: t for i, t in enumerate(ODD)}
    at = 100
    for size in (2, 3, 40, 12):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = [w if rng.random() > 0.04 else word() for w in base]
            texts[at] = " ".join(copy)
            at += 1
    chain = [word() for _ in range(100)]
    for _ in range(25):
        chain = chain[4:] + [word() for _ in range(4)]
        texts[at] = " ".join(chain)
        at += 1
    texts |= {at + i: " ".join(word() for _ in range(30)) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("n", F.lit(1)).repartition(4)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(df, k).collect()}
    assert got == slow_groups(texts, k, 80)
    if k == 5:
        kept = {r.doc_id for r in neardup.keep_first(df).collect()}
        assert kept == {i for i, x in got.items() if x[2]}
    assert neardup.clusters(df.limit(0), k).count() == 0


def test_large_nodes_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "DEEPER", 0, raising=False)
    rng = np.random.default_rng(2)  # here the tree's picks are among the shared coordinates, so that its nodes hold all sets
    same = rng.permutation(neardup.COORDINATES) < 74  # of all sets, too few to make them candidates
    shared = rng.integers(0, 1 << 32, neardup.COORDINATES, dtype=np.uint32)
    rows = []
    for i in range(60):
        own = np.where(same, shared, rng.integers(0, 1 << 32, neardup.COORDINATES, dtype=np.uint32))
        rows += [(2 * i + k, bytearray(own.tobytes()), bytearray(own.astype(np.uint8).tobytes())) for k in (0, 1)]
    reps = spark.createDataFrame(rows, "id bigint, sig binary, short binary")
    found = neardup.common.components(neardup.candidates(reps, 0.8, 1), "test")
    comp = {r.node: r.comp for r in found.collect()}
    assert all(comp.get(2 * i, -1) == comp.get(2 * i + 1, -2) for i in range(60))


def test_components_go_no_further_than_stars(spark, monkeypatch):
    written, rng = [], random.Random(8)
    keep = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, *a: written.append(a) or keep(df, *a))
    stars = [(b + k, b) for b in range(0, 300, 10) for k in range(1, 10)]
    for links in (stars, [(b, a) for a, b in stars] * 2, [(1, 1)], [(5, 9), (9, 7), (7, 7), (3, 8)], [(i, i + 1) for i in range(40)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]):
        want = {}
        for a, b in links:
            if a != b:
                both = {a, b} | want.get(a, set()) | want.get(b, set())
                want |= dict.fromkeys(both, both)
        written.clear()
        got = common.components(spark.createDataFrame(links, "a bigint, b bigint"), "test").collect()
        assert sorted((r.node, r.comp) for r in got) == sorted((x, min(y)) for x, y in want.items())
        assert len(written) == 1 or not set(links) <= {*stars, *((b, a) for a, b in stars), (1, 1)}  # links that are stars take no round
    with pytest.raises(RuntimeError, match="did not settle in 2 rounds"):
        common.components(spark.createDataFrame([(i, i + 1) for i in range(4000)], "a bigint, b bigint"), "test", most=2)


def test_trees_hold_the_miss_rate_at_every_depth():
    for depth in range(1, 7):
        trees = neardup.trees_for(0.8, depth)
        assert neardup.missed(0.8, depth, trees) <= 1e-6 < neardup.missed(0.8, depth, trees - 1)
    assert neardup.missed(0.8, 3, 14) > 1e-6
    rng = np.random.default_rng(5)  # the formula against sets in trees, at a depth and number of trees that lose some
    same = rng.random((4000, neardup.COORDINATES)) < 0.8
    a = rng.integers(0, 1 << 32, same.shape, dtype=np.uint32)
    b = np.where(same, a, a ^ np.uint32(1))
    met = np.zeros(4000, bool)
    for tree in range(2):
        ends = []
        for sig in (a, b):
            node, row = common.mix(np.arange(4000, dtype=np.uint64) * np.uint64(2) + np.uint64(tree)), np.arange(4000)
            for _ in range(4):
                node, row = neardup._children(node, sig, row)
            ends.append((node, row))
        met[ends[0][1][np.isin(ends[0][0], ends[1][0])]] = True
    assert abs((~met).mean() - neardup.missed(0.8, 4, 2)) < 0.03


# --- mixing ---


def slow_fill(budget, children):
    """children: name -> (weight, capacity); fills one child after the other."""
    given, left, open_ = {}, budget, sorted(children)
    while True:
        total = sum(children[c][0] for c in open_)
        full = [c for c in open_ if children[c][1] * total <= left * children[c][0]]
        if not full:
            break
        for c in full:
            given[c] = children[c][1]
        left -= sum(children[c][1] for c in full)
        open_ = [c for c in open_ if c not in full]
    total = sum(children[c][0] for c in open_)
    return given | {c: min(children[c][1], left * children[c][0] // total) if total else 0 for c in open_}


def test_mixing(spark, docs):
    both = docs.unionByName(odd(spark, ODD).withColumn("doc_id", F.col("doc_id") + 10_000), allowMissingColumns=True)
    both = both.unionByName(both.filter("doc_id = 3"))
    for buckets in (4096, 3):
        mixing.BUCKET_ROWS, kept = buckets, mixing.BUCKET_ROWS
        try:
            rows = mixing.mix(both, queries.levels(), queries.WEIGHTS, 0.6, 2, 17).collect()
        finally:
            mixing.BUCKET_ROWS = kept
        got = sorted((r.doc_id, r["__d"], r["__l"], r["__s"], r["epoch"]) for r in _named(rows))
        assert got == sorted(slow_mix(both.collect()))
    assert mixing.mix(docs.limit(0), queries.levels(), queries.WEIGHTS).count() == 0
    named = docs.withColumnRenamed("text", "body").selectExpr("*", "doc_id as __tok", "source as __d", "lang as __key", "'e' as epoch", "1 as __whole")
    rows = mixing.mix(named, queries.levels(), queries.WEIGHTS, text_col="body").collect()
    assert rows and all(r["__tok"] == r.doc_id and r["__key"] == r.lang and r["__whole"] == 1 and r["__d"] != r.source for r in rows)
    plain = mixing.mix(docs, queries.levels(), queries.WEIGHTS).collect()
    assert sorted((r.doc_id, r.epoch) for r in rows) == sorted((r.doc_id, r.epoch) for r in plain)


def _named(rows):
    """Rows as dictionaries whose last column of a name wins: the operator's epoch comes after a clashing one."""

    class Row(dict):
        __getattr__ = dict.__getitem__

    return [Row(zip(r.__fields__, r, strict=True)) for r in rows]


def slow_mix(rows):
    leaf = {}
    for r in rows:
        m = re.search("([0-9]{1,9})$", r.source or "")
        key = (("web", "books", "forum")[int(m[1]) % 3] if m else "other", r.lang or "", r.source or "")
        leaf.setdefault(key, []).append((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    w = queries.WEIGHTS
    cap = lambda *p: sum(2 * n for k, n in tokens.items() if k[: len(p)] == p)
    out = []
    domains = slow_fill(int(sum(tokens.values()) * 0.6), {d: (w["domain"].get(d, 1), cap(d)) for d in {k[0] for k in leaf}})
    for d, b in domains.items():
        for lang, c in slow_fill(b, {x: (w["language"].get(x, 1), cap(d, x)) for x in {k[1] for k in leaf if k[0] == d}}).items():
            for s, given in slow_fill(c, {x: (w["source"].get(x, 1), cap(d, lang, x)) for x in {k[2] for k in leaf if k[:2] == (d, lang)}}).items():
                key = (d, lang, s)
                whole = min(given // tokens[key], 2) if tokens[key] else 0
                rest = given - whole * tokens[key] if whole < 2 else 0
                for e in range(whole):
                    out += [(i, *key, e) for i, _ in leaf[key]]
                total = 0
                if rest > 0:
                    for _, n, i in sorted((hashlib.md5(f"17|{whole}|{i}".encode()).hexdigest(), n, i) for i, n in leaf[key]):
                        total += n
                        if total <= rest:
                            out.append((i, *key, whole))
    return out


# --- language ---


def test_language(spark, docs):
    model = langid.train(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    strange = odd(spark, [*ODD, "123 456", "٣٤ !!"]).withColumn("__t", F.lit("x"))
    got = {r.doc_id: r for r in langid.predict(strange, model).collect()}
    assert [i for i, r in got.items() if r.lang_pred == "und"] == [0, 1, 2, 13, 14] and got[0].score == 0
    assert all(r.lang_pred == "und" for r in langid.predict(strange, None).collect())
    assert langid.train(docs.limit(0)) is None
    assert langid.accepted(strange.unionByName(docs, allowMissingColumns=True)).columns == strange.columns
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_is_learned_in_a_task(docs, monkeypatch):
    rows = [(r.text, r.lang) for r in sorted(langid.sample(docs).collect(), key=lambda r: (r.lang, r.r))]
    want = langid.fit(rows)
    monkeypatch.setattr(langid, "presence", None)  # here, not in workers
    got = langid.train(docs)
    assert got.languages == want.languages and all((a == b).all() for a, b in zip(got.vocabulary, want.vocabulary, strict=True))
    assert (got.landmarks == want.landmarks).all() and np.allclose(got.weights, want.weights, atol=0.001) and np.allclose(got.bias, want.bias, atol=0.001)  # rounding goes by the process's number of threads


def test_learning_goes_block_by_block(monkeypatch):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 90))), rng.choice(["x", "y"])) for _ in range(60)]
    whole, most = langid.fit(rows), []
    codes, blocks = langid.gram_codes, common.blocks
    monkeypatch.setattr(common, "blocks", lambda off, most=100: blocks(off, most))
    monkeypatch.setattr(langid, "gram_codes", lambda raw, off, order: most.append(len(raw)) or codes(raw, off, order))
    got = langid.fit(rows)
    assert max(most) <= 200 and all((a == b).all() for a, b in zip(got.vocabulary, whole.vocabulary, strict=True))
    assert (got.landmarks == whole.landmarks).all() and (got.weights == whole.weights).all() and (got.bias == whole.bias).all()


def test_kernel_is_exact():
    rows = [("the cat sat", "en"), ("der hund lief", "de"), ("the dog ran", "en"), ("die katze", "de")]
    model = langid.fit(rows, least=1)
    raw = b"".join(t.encode() for t, _ in rows)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t, _ in rows])])
    at = np.concatenate([[0], np.cumsum([len(v) for v in model.vocabulary])]).tolist()
    x = langid.presence(np.frombuffer(raw, np.uint8), off, model.tables(), at[-1], at)
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            k = 0
            for n in langid.ORDERS:
                p, q = ({t[m : m + n] for m in range(len(t) - n + 1)} for t in (a, b))
                k += len(p & q) / (len(p) * len(q)) ** 0.5 / 3
            assert abs(float(x[i] @ x[j]) - k) < 1e-5


# --- chats ---


def test_chats_round_trip(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "&", "&amp;", "&lt;|", "&nl;", "\n", "<|", "|>", "é", "x", "", "assistant\n"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, None if rng.random() < 0.05 else t % 5, rng.choice(["user", "assistant", "assistant", None, "a\nb<|im_start|>&"]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))))
    rows += [(None, 0, "user", "x"), (99, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)).repartition(3)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    spans = {r.conv_id: r for r in formatted.collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        assert got[c].loss_text == "".join(x for _, r, x in mine if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == 1 + sum(a[1] != b[1] for a, b in zip(mine[:-1], mine[1:], strict=True))
        under = "".join(spans[c].formatted[s.start : s.end] for s in spans[c].loss_spans)
        assert under.replace("&lt;|", "<|").replace("&amp;", "&") == got[c].loss_text
    assert chat.format_chats(df.limit(0)).count() == 0


# --- licences ---


def test_licences(spark, docs):
    s = licenses.SENTENCES
    texts = [
        None,
        "",
        f"Intro. {s['ApacheV2']}. More text",
        "\n\n".join(["MIT License", s["MitGrant"], s["MitNotice"] + ".", s["MitAsIs"] + ". IN NO EVENT"]),
        f"{s['Mpl2']}. If a copy",
        "a license of some kind. And no warranty",
        f"{s['Gpl2Free']}; {s['Gpl2Terms']}; {s['Gpl2Later']}.",
        s["ApacheV2"].upper() + "  ",
        f"{s['MitNotice']}. {s['MitGrant']}",
        "word " * 50_000 + ". " + s["Cc0"] + ".",
    ]
    got = [r for r in licenses.scan(odd(spark, texts)).orderBy("doc_id").collect()]
    assert [r.licenses for r in got] == ["", "", "Apache-2.0", "MIT", "MPL-2.0", "", "GPL-2.0-or-later", "Apache-2.0", "", "CC0-1.0"]
    assert [r.n_unknown for r in got] == [0, 0, 0, 0, 0, 2, 0, 0, 0, 0]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licence_versions_are_told_apart(spark):
    s = licenses.SENTENCES
    lib = s["LibFree"] + "; " + s["LgplFree"] + "; "
    cases = {
        s["Gpl2Free"] + "; " + s["Gpl2OnlyTerms"] + ".": "GPL-2.0-only",
        f"{s['Gpl2Free']}; {s['Gpl2Terms']}; {s['Gpl2Only']}.": "GPL-2.0-only",
        s["AgplFree"] + ". " + s["GplHope"] + ". " + s["AgplDetails"] + ".": "AGPL-3.0-or-later",
        lib + s["Lgpl21Later"] + ".": "LGPL-2.1-or-later",
        lib + s["Gpl2Later"] + ".": "LGPL-2.0-or-later",
        lib + "or else.": "LGPL",
        s["Lgpl3Free"] + ".": "LGPL-3.0-or-later",
        "Terms. " + s["Epl2"] + "\nhttps://x.example": "EPL-2.0",
        s["Unlicense"] + ".": "Unlicense",
        s["ZlibAsIs"] + ". Never. " + s["ZlibGrant"]: "Zlib",
        s["BoostGrant"]: "BSL-1.0",
        "\n".join([s["BsdRedist"], "1. " + s["BsdSource"] + ".", "2. " + s["BsdBinary"] + ".", "3. " + s["BsdAdvert"], "This product.", s["BsdEndorse"] + "."]): "BSD-4-Clause",
        s["Gpl2Free"] + "; " + s["PerlTerms"] + ".": "Perl",
    }
    cases |= {f"{s[k]}\nx": name for name, k in licenses.RULES if k.startswith("Spdx")}
    got = licenses.scan(odd(spark, list(cases))).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == list(cases.values())


def test_wrapped_licences(spark):
    s = licenses.SENTENCES
    fill = lambda text, mark="", width=60: textwrap.fill(text, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False)
    mit = ["MIT License", "Copyright (c) 2020 A. Person", s["MitGrant"], s["MitNotice"] + ".", s["MitAsIs"] + ". IN NO EVENT SHALL"]
    gpl = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", s["GplHope"] + ". " + s["GplDetails"] + "."]
    lgpl = ["This library is it. " + s["Gpl2Free"] + "; " + s["LgplFree"] + "; or so"]
    bsd = [s["BsdRedist"], "1. " + s["BsdSource"] + ".", "2. " + s["BsdBinary"] + ".", "3. " + s["BsdEndorse"] + "."]
    apache = [f"{s['ApacheV2Long']}; {s['ApacheUse']}. {s['ApacheCopy']}", "http://example.org/", f"{s['ApacheAsIs']}. {s['ApacheSee']}."]
    texts, want = [], []
    for parts, name in ((mit, "MIT"), (gpl, "GPL-2.0-or-later"), ([s["GplFree"] + "."], "GPL-3.0-or-later"), (lgpl, "LGPL"), (bsd, "BSD-3-Clause"), ([s["IscGrant"] + "."], "ISC"), (apache, "Apache-2.0")):
        for mark in ("", " * ", "# ", "// "):
            texts.append("int x;\n" + f"\n{mark}\n".join(fill(p, mark) for p in parts) + "\n\nint y;")
            want.append(name)
    texts += ["\n".join(["MIT License", "Copyright (c) A", *textwrap.wrap(s["MitGrant"], 50), "", *textwrap.wrap(s["MitNotice"] + ".", 50)]).replace("\n", "\r\n"), "Permission is hereby granted\n\n, free of charge"]
    want += ["MIT-style", ""]
    rows = licenses.scan(odd(spark, texts)).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == want
    assert [r.n_unknown for r in rows[:4]] == [0] * 4


# --- pieces ---


def test_hash_ranges_and_words():
    raw = np.frombuffer(b"abcabc  abc\tab", np.uint8)
    h = common.Prefix(raw)
    a = h(np.array([0, 3, 8, 1]), np.array([3, 6, 11, 4]))
    assert a[0] == a[1] == a[2] != a[3]
    assert (h.grams(3)[[0, 3, 8]] == h.grams(3)[0]).all()
    s, e, first = common.words(raw, np.array([0, 4, 4, 14]))
    assert [raw[x:y].tobytes() for x, y in zip(s, e, strict=True)] == [b"abca", b"bc", b"abc", b"ab"] and first.tolist() == [0, 1, 1, 4]
