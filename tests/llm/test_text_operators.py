"""Text operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import (
    bpe, chat, components, decontaminate, fmindex, gru, jaccard, langid, lstmcrf, packs, pii, quality, shared, substrings, warc, wordhash, wordpiece,
)

WS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n_words string, row string, spans string, score string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "s") for i, t in rows], DOCS)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(200)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    out = list(base)
    for t in base[:20]:  # near copies and shared passages
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append("start\t" + " ".join(base[25].split()[:80]) + "\u00a0end " + t[:30])
    out += [base[0], base[0], "", None, "   \n ", "one", "one", "a b c d", "x" * 5000, "é" + "long " * 3000]
    return list(enumerate(out))


# --- archives -------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 800 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a b/", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert all(r.gap is None for r in got.values()) and len(got) == 6
    for i, _, html in rows:
        r = got[f"<urn:page:{i}>"]
        body = (html or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        revisit = html == big and i != 9
        assert (r.record_type, r.refers_to) == (("revisit", "<urn:page:9>") if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else body)
    assert got["<urn:page:1>"].url == "http://a b/" and got["<urn:page:2>"].url is None
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def record(k, body=b"hello"):
    digest = hashlib.sha1(body).hexdigest().encode()
    return b"WARC/1.1\r\nWARC-Record-ID: %d\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, digest, len(body), body)


def test_warc_files_stay_bounded_and_repeats_are_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", ((100, 10), (2000, 3), (None, 1)))
    rows = [(k % 50, f"http://h/{k}\x00 %20", "x" * (5000 if k % 20 == 7 else 1500 if k % 3 else 5), "clash") for k in range(100)]
    pages = spark.createDataFrame([*rows, (None, None, None, None)], "page_id long, url string, html string, payload_digest string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(got) == 101 and not any(r.gap for r in got) and sorted(str(r.url) for r in got) == sorted([*[str(x[1]) for x in rows], "None"])
    per_file = {}
    for r in got:
        per_file.setdefault(r.path, []).append(len(bytes(r.payload)))
    assert all(len(x) <= (10 if max(x) <= 100 else 3 if max(x) <= 2000 else 10) for x in per_file.values()) and len(per_file) > 10
    for r in got:  # of equal payloads the largest id is the response, in every row that has it
        if r.record_type == "response" and r.payload_bytes >= 1000:
            assert (r.payload_bytes, r.record_id) in {(5000, "<urn:page:47>"), (1500, "<urn:page:49>")}
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest and len(bytes(r.payload)) == r.payload_bytes


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_goes_on_after_damage(zipped):
    parts = [record(k, b"body %d " % k * 50) for k in range(6)]
    if zipped:
        parts = [gzip.compress(p) for p in parts]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(broken) + parts[3] + b"\x00\x01" + parts[4] + parts[5][: len(parts[5]) // 2]
    got = list(warc.salvage(data))
    ids = [x["fields"]["warc-record-id"] for kind, _, _, x in got if kind == "record"]
    assert ids == ["0", "1", "3", "4"]
    assert got[0][:3] == ("gap", 0, 4)
    ends = [(a, b) for _, a, b, _ in got]
    assert ends[0][0] == 0 and ends[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
    assert list(warc.salvage(b"")) == []


# --- substrings -----------------------------------------------------------------------------------------------------

def brute_repeats(rows, k=35):
    seen, words = {}, [WS.findall(t or "") for _, t in rows]
    for r, w in enumerate(words):
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append((r, i))
    gone = [set() for _ in rows]
    for at in seen.values():
        if len(at) > 1:
            for r, i in at:
                gone[r].update(range(i, i + k))
    return sorted(((i, len(w), len(g), " ".join(x for p, x in enumerate(w) if p not in g)) for (i, _), w, g in zip(rows, words, gone)), key=str)


@pytest.mark.parametrize("pack_bytes", [400, packs.PACK_BYTES])
def test_substrings_equal_brute_force(spark, monkeypatch, pack_bytes):
    monkeypatch.setattr(packs, "PACK_BYTES", pack_bytes)
    rows = corpus()
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got), key=str) == brute_repeats(rows)
    for r in got:
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


# --- word pieces ----------------------------------------------------------------------------------------------------

def test_word_pieces_equal_greedy_matching(spark):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    first, rest = wordpiece.vocabulary(path)
    vocab = {p: k for k, p in enumerate(dict.fromkeys([*first, *["##" + p for p in rest], "[UNK]"]))}
    model = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    texts = [t for _, t in corpus()] + ["unaffable tokenization ünïcode 漢字\u200b x\x00y", "\U0001f600 zzzzqqq"]
    got = {r.doc_id: r for r in wordpiece.token_counts(frame(spark, list(enumerate(texts))), path).collect()}
    for k, t in enumerate(texts):
        words = WS.findall(t or "")
        expected = [model.encode(w).tokens for w in words]
        assert (got[k].n_words, got[k].n_tokens, got[k].n_unknown) == (
            len(words), sum(map(len, expected)), sum(e == ["[UNK]"] for e in expected))
    assert wordpiece.token_counts(frame(spark, []), path).count() == 0


def test_automaton_on_random_vocabularies():
    rng = random.Random(5)
    for _ in range(300):
        first = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(3)}
        rest = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(4)}
        auto = wordpiece.Automaton(first, rest)
        for _ in range(20):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            at = n = 0
            while at < len(w):
                end = next((e for e in range(len(w), at, -1) if w[at:e] in (rest if at else first)), 0)
                if not end:
                    n = 0
                    break
                at, n = end, n + 1
            assert auto.count(w) == n


# --- decontamination ------------------------------------------------------------------------------------------------

def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for size in (3, 4, 10):
        text = rng.integers(2, size, 300) if size > 3 else np.full(40, 2)
        text[[11, 12, 30]] = 1  # boundaries, which no phrase holds
        index = fmindex.FMIndex(text, size)
        phrases = [rng.integers(2, size, n) for n in (1, 2, 3, 5)] + [text[13:26], text[-3:], text[4:11]]
        table = np.zeros((len(phrases), 13), np.int64)
        for k, p in enumerate(phrases):
            table[k, : len(p)] = p
        lo, hi = index.ranges(table, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, lo, hi):
            expected = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


@pytest.mark.parametrize(("block", "piece"), [(decontaminate.BLOCK_BYTES, decontaminate.PIECE_WORDS), (200, 15)])
def test_contamination_equals_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000 if piece == 15 else decontaminate.SHARD_BYTES)
    rows = corpus()
    items = [(k, " ".join(rows[k][1].upper().split()[:20])) for k in range(0, 30, 3)] + [(100, None), (101, ""), (102, "a,b;C"), (103, "ONE"), (104, rows[0][1])]
    items += [(None, rows[4][1]), (None, rows[7][1][:60]), (0, rows[8][1]), (0, rows[8][1]), (105, " ".join(x[1] or "" for x in rows[:9]))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = lower(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    got = decontaminate.find_contamination(
        frame(spark, rows), spark.createDataFrame([(*x, "i", 1) for x in items], "item_id long, text string, i string, doc_id long"), block_bytes=block
    ).withColumn("c", decontaminate.contaminated()).collect()
    assert len(got) == len(rows)
    for r in got:
        w, hit, found = lower(dict(rows)[r.doc_id]), set(), set()
        for p, i in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= i
        assert r.n_words == len(w) and list(r["items"]) == sorted(found)
        assert {x for a, b in zip(r.starts, r.ends) for x in range(a, b)} == hit
        assert r.c == (len(hit) > 0 and 20 * len(hit) >= len(w))
    none = spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r["items"]) for r in decontaminate.find_contamination(frame(spark, rows), none).collect()} == {()}


# --- personal data --------------------------------------------------------------------------------------------------

def plain_rules(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            s = m.group()
            d = "".join(c for c in s if c in "0123456789")
            ok = k == 0 or k == 1 and all(int(x) <= 255 for x in s.split(".")) or k == 2 and 13 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15
            if ok:
                out.append((k, *m.span()))
    return out


def test_rules_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["@", ".", "a", "b-", "1", "25", "256", "+", " ", "(", "-", "é", "4111 1111 1111 1111", "1.2.3", "x@y.z"]) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == plain_rules(t)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@") == []


def test_crf_gradients_and_decoding():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lstmcrf.init(3).items()}
    p["trans"], p["begin"] = rng.standard_normal((3, 3)), rng.standard_normal(3)
    m, y = rng.integers(0, 99, (2, 5)), rng.integers(0, 3, (2, 5))
    _, g = lstmcrf.gradients(p, m, y)
    for k in ("trans", "out", "hf", "cb"):
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        a, b = ({**p, k: p[k].copy()} for _ in range(2))
        a[k][at] += 0.01
        b[k][at] -= 0.01
        assert abs((lstmcrf.gradients(a, m, y)[0] - lstmcrf.gradients(b, m, y)[0]) / 0.02 - g[k][at]) < 1e-3
    e = lstmcrf.emissions(p, m)[0]
    score = lambda w, b: p["begin"][w[0]] + sum(e[t, b, w[t]] for t in range(5)) + sum(p["trans"][w[t], w[t + 1]] for t in range(4))
    every = [tuple((n // 3**t) % 3 for t in range(5)) for n in range(3**5)]
    for b, row in enumerate(lstmcrf.decode(p, m)):
        assert tuple(row) == max(every, key=lambda w: score(w, b))
    p["bias"][0] += 20  # now 0 wins everywhere, which is seen without a search
    assert len(lstmcrf.open_rows(p, m)[0]) == 0 and not lstmcrf.decode(p, m).any()


def test_only_rows_with_a_gaining_span_are_searched():
    p = lstmcrf.init(5)
    p["out"] *= 20
    p["trans"] = (np.eye(5) * 2.8 - 1.2).astype(np.float32)
    for bias in range(7):
        p["bias"][0] = bias
        for width in (1, 2, 40):
            m = np.random.default_rng(3).integers(0, 99, (300, width))
            e = np.ascontiguousarray(lstmcrf.emissions(p, m)[0].transpose(0, 2, 1))
            full, (found, scores) = lstmcrf.best(p, e).T, lstmcrf.open_rows(p, m)
            assert np.array_equal(lstmcrf.decode(p, m), full) and np.allclose(scores, e[:, :, found], atol=1e-4)
            assert len(found) <= 5 + 1.2 * full.any(1).sum()


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_pii_keeps_base_and_adds_loose_forms(spark, tagger):
    rows = [(1, "pay 4387.5130.3523.7269 soon"), (2, None), (3, ""), (4, "x" * 3000 + " me@site.example.com " + "y" * 3000), (4, "none here"), (6, "é +1 (456) 555-2186 und 10.0.0.1 end")]
    got = pii.find_pii(frame(spark, rows), tagger).withColumn("m", pii.masked(F.col("text"), F.col("spans"))).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.spans if s.base]
        assert base == plain_rules(r.text or "")
        places = sorted((s.start, s.end) for s in r.spans)
        for s in r.spans:
            if not s.base:
                assert all(s.end <= a or s.start >= b or (a, b) == (s.start, s.end) for a, b in places)
    text = {r.m for r in got}
    assert "é [phone] und [ip] end" in text and None in text and "" in text
    found = pii.add_spans(["pay 4387.5130.3523.7269 soon"], [[]], tagger)
    assert found == [[(2, 4, 23)]]
    assert pii.add_spans(["", "x"], [[], []], tagger) == [[], []] and pii.add_spans([], [], tagger) == []
    assert pii.find_pii(frame(spark, []), tagger).count() == 0


def test_tagger_recall_on_held_out_spans(spark, tagger):
    texts = [r.text[:700] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").limit(300).collect()]
    rng, got = np.random.default_rng(99), {k: [0, 0] for k in range(4)}
    marked, gold = [], []
    for t in texts:
        cut = [i for i, c in enumerate(t) if c == " "]
        kind, s = pii._loose(rng)
        i = cut[rng.integers(len(cut))] + 1 if cut else 0
        marked.append(t[:i] + s + " " + t[i:])
        gold.append((kind, i, i + len(s)))
    base = [pii.base_spans(t) for t in marked]
    for (kind, a, b), own, new in zip(gold, base, pii.add_spans(marked, base, tagger)):
        if not any(x < b and z > a for _, x, z in own):  # the rules miss it
            got[kind][0] += any(x < b and z > a for _, x, z in new)
            got[kind][1] += 1
    assert all(a >= 0.9 * b and b > 10 for a, b in got.values()), got  # of each kind
    base = [pii.base_spans(t) for t in texts]
    assert sum(map(len, pii.add_spans(texts, base, tagger))) <= 3  # and clean texts stay clean


def test_labels_are_stitched_over_windows(monkeypatch):
    """A made-up tagger marks every x: runs of any length come out whole wherever windows end."""
    def open_rows(_, m):
        e = np.zeros((m.shape[1], 5, len(m)), np.float32)
        e[:, 2] = np.where(m.T == ord("x") - 32, 9, -9)
        return np.arange(len(m)), e

    monkeypatch.setattr(pii.lstmcrf, "open_rows", open_rows)
    monkeypatch.setattr(pii, "WIDTH", 64)
    monkeypatch.setattr(pii, "STRIDE", 48)
    weights = pii.lstmcrf.init(5)
    for n in (0, 1, 40, 64, 65, 112, 300):
        for at in (0, 3, 47, 60, 111):
            t = "a" * at + "x" * n + "b" * 50 + "x"
            (y,) = pii.labels([t], weights)
            assert "".join("x" if v == 2 else "." for v in y) == re.sub("[^x]", ".", t)


# --- byte-level BPE -------------------------------------------------------------------------------------------------

def plain_merges(word, ranks):
    """Rank merges as they are defined: the lowest pair, the leftmost of equals, again and again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_merges_equal_plain_rank_merges():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    words = ["".join(rng.choice("theandqué \n漢") for _ in range(rng.randrange(1, 40))).encode() for _ in range(800)]
    words += [b"a" * 300, b" " * 200, bytes(range(256)), b"x", "".join(rng.choice("abc") for _ in range(400)).encode()]
    for w in words:
        assert bpe.merged(w, ranks) == bpe._merged_long(w, ranks) == plain_merges(w, ranks), w
    assert len(bpe.merged(b"ab" * 200_000, ranks)) > 1  # long words take n log n


@pytest.mark.parametrize("size", [600, 1 << 20])
def test_bpe_equals_library_and_round_trips(spark, monkeypatch, size):
    import tiktoken

    monkeypatch.setattr(packs, "PACK_BYTES", size)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", size)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = corpus() + [(900, "a\x00b  \n\n c'est 12³ <|endoftext|>"), (900, "a\x00b  \n\n c'est 12³ <|endoftext|>"), (901, "漢字\u3000\U0001f600")]
    got = bpe.decode(bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN), path).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        ids = lib.encode_ordinary(text[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (text[r.doc_id] or "").encode()
    assert bpe.decode(bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN), path).count() == 0
    none = bpe.decode(bpe.encode(frame(spark, [(1, None), (2, ""), (None, "x")]), path, public_tokenizers.PATTERN), path).collect()
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in none), key=str) == [(1, 0, b""), (2, 0, b""), (None, 1, b"x")]


# --- chat -----------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    bad = ["\\### x", "</turn>\n### user: hi", "<part/>", "#### a", "\\", "\\h## ", "\\\\l", "<</turn>", "end<", "</tur", "", None, "ok", "\\l/turn>"]
    rows = [(c, t, ("user", "assistant", "assistant", "a:b", None)[(t * (c + 1)) % 5], bad[(c * 3 + t) % len(bad)], "x") for c in range(9) for t in range(12)]
    rows += [(None, 0, "user", "lost", "x"), (3, 4, "user", "same turn", "x"), (3, 4, "user", "same turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_chat(out).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for k, t, r, x, _ in rows if k == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
    for r in out.collect():
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
        at, said = 0, []
        for m in r.loss_mask:
            if m.loss:
                said.append(r.formatted[at : at + m.chars])
            at += m.chars
        own = [t.text for t in got[r.conv_id].turns if t.role == "assistant"]
        assert len(said) == len(own) and all(len(a) >= len(b) for a, b in zip(said, own))
    assert chat.format_chat(df.limit(0)).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------

def test_quality_counts_and_verdicts(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "tau"]) + str(rng.randrange(999)) for _ in range(60)) for _ in range(80)]
    odd = ["# $ % " * 40 + " ".join(clean[0].split()[:20]), ("same line here\n" * 30), None, "", "few words"]
    rows = [(k, t, "en", None if k % 2 else "s") for k, t in enumerate(clean + odd)]
    got = {r.doc_id: r for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for k, t, _, _ in rows:
        w = WS.findall(t or "")
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        rep = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WS.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert all(got[k].kept for k in range(80)) and not any(got[k].kept for k in range(80, 85))
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.quality_filter(none).count() == 0


def test_limits_come_from_the_sketches(spark):
    """Limits in force on the given documents differ between groups, and follow the data when its scale changes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    feats = quality.features(docs.withColumn("source", F.lit("one")), "doc_id", "text", "lang", "source")
    of = lambda t: {(r.lang, m): (r.limits[m].low, r.limits[m].high) for r in t.collect() for m in (*quality.SPAN, *quality.CUT)}
    got = of(quality.thresholds(feats))
    assert len({v for (_, m), v in got.items() if m == "word_length"}) > 1 and len({v for (_, m), v in got.items() if m == "symbols"}) > 1
    twice = of(quality.thresholds(feats.withColumn("n_symbols", F.col("n_symbols") * 8).withColumn("word_chars", F.col("word_chars") * 8)))
    for (lang, m), (_, high) in got.items():
        if m in ("symbols", "word_length") and high:
            assert 7 < twice[lang, m][1] / high < 9, (lang, m)  # an eightfold scale moves every limit along: none is a constant


def test_quality_takes_long_texts_repeats_and_clashing_names(spark):
    long = "word " * 5 + " ".join(f"t{k}" for k in range(30000))
    rows = [(1, long, "en", "s", "x", "y"), (1, long, "en", "s", "x", "y"), (None, "a b c d e f g h i j k", None, None, None, None), (2, None, "en", None, "x", "y")]
    got = quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, limits string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.base_failed) for r in got) == [("1", 30005, False), ("1", 30005, False), ("2", 0, True), ("None", 11, False)]


# --- near duplicates ------------------------------------------------------------------------------------------------

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            if a and sets[k] and 100 * len(a & sets[k]) >= 80 * len(a | sets[k]):
                up[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    rows = corpus(n=40)
    template = [f"t{k}" for k in range(70)]
    for k in range(80):  # many edits of one text, around the threshold
        w = list(template)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        rows.append((1000 - k, " ".join(w)))
    rows.append((rows[0][0], rows[0][1]))
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "KEY_ROWS", 4)
    rows = [(k, " ".join([f"t{i}" for i in range(70)] + [f"e{k}"])) for k in range(60)] + corpus(n=40)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_only_likely_pairs_have_their_texts_fetched(spark):
    common = [f"t{i}" for i in range(40)]
    rows = [(k, " ".join(common + [f"e{k}x{i}" for i in range(4 * k)])) for k in range(60)]
    j = jaccard._Join(frame(spark, rows), "doc_id", "text")
    size = {bytes(r["class"]): r.n for r in j.classes.collect()}
    keyed = j.keyed()
    for pivots in jaccard.PIVOTS:
        pairs = {(size[bytes(r.a)], size[bytes(r.b)]) for r in j.star(keyed, None, pivots).collect()}
        assert pairs and all(5 * min(p) >= 4 * max(p) for p in pairs)


def test_links_without_agreeing_keys_are_found_by_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "AGREE", jaccard.KEYS + 1)
    rows = [(k, " ".join([f"t{i}" for i in range(70)] + [f"e{k % 20}"])) for k in range(30)] + [(100 + i, t) for i, (_, t) in enumerate(corpus(n=40))]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_texts_that_come_by_a_shuffle_are_saved_once(spark, monkeypatch):
    plain, names = jaccard.saved, []
    monkeypatch.setattr(jaccard, "small_or_plain", lambda df, *a: df)
    monkeypatch.setattr(jaccard, "saved", lambda df, name, *a: names.append(name) or plain(df, name, *a))
    rows = [(i, t) for i, (_, t) in enumerate(corpus(n=40))]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert names.count("texts") == 1


def test_components_of_nothing(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    got = jaccard.near_duplicates(frame(spark, [(1, None), (2, ""), (None, "alone in the world of texts")])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == [(1, 0, 1), (2, 0, 2), (None, 2, None)]


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100)], "a long, b long")
    assert {(r.node, r.comp) for r in components.components(links).collect()} == {(k, 0) for k in range(61)}


# --- language identification ----------------------------------------------------------------------------------------

def test_gru_gradients():
    p = {k: v.astype(np.float64) for k, v in gru.init(3).items()}
    m = np.frombuffer(b"abc de hello!  x y z ", np.uint8).reshape(3, 7)
    y, on = np.array([0, 2, 1]), gru.is_letter(m)
    _, g = gru.gradients(p, m, on, y)
    for k, at in (("out", (3, 1)), ("hf", (2, 2 * gru.HIDDEN + 4)), ("hb", (5, 3 * gru.HIDDEN - 1)), ("xf", (ord("l"), 2 * gru.HIDDEN + 1)), ("xb", (32, 4)), ("cb", (7,))):
        a, b = ({**p, k: p[k].copy()} for _ in range(2))
        a[k][at] += 0.01
        b[k][at] -= 0.01
        assert abs((gru.gradients(a, m, on, y)[0] - gru.gradients(b, m, on, y)[0]) / 0.02 - g[k][at]) < 1e-3


def plain_network(p, data):
    """Mean label probabilities of a document's letters, one stretch and one byte at a time."""
    H, total, n = gru.HIDDEN, np.zeros(len(p["bias"])), 0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for at in range(0, len(data), gru.CORE):
        core = min(gru.CORE, len(data) - at)
        width = -(-core // 32) * 32
        seq = [data[i] if 0 <= i < len(data) else 32 for i in range(at - gru.EDGE, at + width + gru.EDGE)]
        states = {}
        for d in "fb":
            h, out = np.zeros(H), []
            for x in seq if d == "f" else seq[::-1]:
                a, g = p["x" + d][x].astype(float), h @ p["h" + d].astype(float) + p["c" + d]
                z, r = sigmoid(a[:H] + g[:H]), sigmoid(a[H : 2 * H] + g[H : 2 * H])
                new = np.tanh(a[2 * H :] + r * g[2 * H :])
                h = (1 - z) * new + z * h
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        for i in range(core):
            b = data[at + i]
            if b >= 128 or chr(b).isalpha():
                s = np.concatenate([states["f"][gru.EDGE + i], states["b"][gru.EDGE + i]]) @ p["out"] + p["bias"]
                total += np.exp(s) / np.exp(s).sum()
                n += 1
    return total / max(n, 1), n


def test_prediction_equals_the_plain_network(spark):
    from types import SimpleNamespace

    weights = gru.init(3, seed=9)
    weights["out"] *= 20
    texts = ["one é two", "x", "", "long text, with 12 words; " * 60, "ß" * 300, "a" * gru.CORE, "b" * (gru.CORE + 1), "1 2 3", None]
    got = {r.doc_id: r for r in langid.predict(frame(spark, list(enumerate(texts))), (["aa", "bb", "cc"], weights)).collect()}
    for k, t in enumerate(texts):
        score, n = plain_network(weights, (t or "").encode())
        best = SimpleNamespace(lang="und", score=0.0) if not n else SimpleNamespace(lang=["aa", "bb", "cc"][int(score.argmax())], score=score.max())
        assert got[k].lang_pred == best.lang and abs(got[k].score - best.score) < 1e-4


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.where(fold != 1))
    got = langid.predict(docs.where(fold == 1), model, whole_row=True)
    total, right = got.agg(F.count("*"), F.sum((F.col("lang_pred") == F.col("row.lang")).cast("int"))).first()
    assert right / total > 0.95
    odd = {r.doc_id: r for r in langid.predict(frame(spark, [(1, None), (2, ""), (3, "12 !!"), (4, "the " * 20000), (4, "the " * 20000)]), model).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (1, 2, 3)) and odd[4].lang_pred == "en" and 0 < odd[4].score <= 1
    empty = langid.fit(docs.limit(0))
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, "hi")]), empty).collect()] == ["und"]


# --- pipeline -------------------------------------------------------------------------------------------------------

def test_pipeline_stages_decide_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["language_id"](spark, docs, sf).count() == docs.count()
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(1).withColumn("text", F.lit("1234 !!")).withColumn("doc_id", F.lit(10**6))
    assert stages["language_id"](spark, docs.unionByName(odd), sf).count() == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    near = stages["near_duplicates"](spark, docs.union(docs.limit(3)), sf)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in brute_components(rows)})
    clean = stages["decontamination"](spark, docs, sf)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    mask = {r.doc_id: r for r in stages["personal_data"](spark, docs, sf).collect()}
    for i, t in rows:
        assert not plain_rules(mask[i].text) and mask[i].n_chars == len(mask[i].text)
        if not re.search("[0-9@]", t):
            assert mask[i].text == t
    assert {(r.doc_id, r.text) for r in stages["byte_bpe"](spark, docs, sf).collect()} == set(rows)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_without_ids_are_all_others(spark, kind):
    rows = [*range(3000), None, None, 7, 8]
    docs = spark.createDataFrame([(i, f"t{i}") for i in rows], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    for gone in ([], [7, *range(100, 200), 10**6], [None, 8], [*range(5000), None]):
        ids = shared.saved(spark.createDataFrame([(i,) for i in gone], "doc_id long").select(F.col("doc_id").cast(kind)), "gone")
        want = sorted(f"t{i}" for i in rows if i not in gone)
        for bound in (0, 32 << 20):
            out = shared.without(docs, "doc_id", ids, bound)
            assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == want
        passing = shared.sieve(ids)
        may, never = (passing(docs, "doc_id", how).count() for how in ("left_semi", "left_anti"))
        hit = sum(i in gone for i in rows)
        assert may + never == len(rows) and hit <= may <= hit + (len(rows) - hit) / 8


def test_near_duplicates_leave_most_texts_where_they_are(spark, monkeypatch):
    """Neither with few ids nor with more than may be broadcast are the rows that stay dealt by id."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few = corpus_pipeline.near_duplicates(spark, docs, sf)
        assert sorted(r.doc_id for r in few.collect()) == want
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        dealt = []
        monkeypatch.setattr(shared, "small_or_plain", lambda df, *a: df)
        monkeypatch.setattr(jaccard, "small_or_plain", lambda df, *a: df)
        sieve = shared.sieve

        def counted(ids):
            passing = sieve(ids)

            def run(rows, key, how):
                out = passing(rows, key, how)
                if how == "left_semi":
                    dealt.append((out.count(), ids.count(), rows.count()))
                return out

            return run

        monkeypatch.setattr(shared, "sieve", counted)
        monkeypatch.setattr(jaccard, "sieve", counted)
        many = corpus_pipeline.near_duplicates(spark, docs, sf)
        assert sorted(r.doc_id for r in many.collect()) == want
        assert len(dealt) >= 3 and all(n <= ids + rows / 8 for n, ids, rows in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_ids_keep_a_row_of_each_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, a), (3, a), (None, a), (None, "alone in the world"), (4, None), (4, None)]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), None).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted({(1, a), (2, a), (2, b), (None, a), (None, "alone in the world"), (4, None)}, key=str)


def test_pipeline_stages_take_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeats, clashing columns, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = {"row": F.lit("r"), "spans": F.lit(1), "score": F.lit(0.5), "n_words": F.lit(2), "class": F.lit("c"), "items": F.lit("i")}
    docs = some.withColumns(extra)
    odd = [(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6 + 1, "the and of to in is " * 9000, None, "s", None), (None, "only one like this in all the world of texts", "en", "s", 1)]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    docs = docs.unionByName(rows.select(*docs.columns)).unionByName(docs.limit(2))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0, name
        got = out.collect()
        if name == "byte_bpe":
            assert len(got) == docs.count() and {r.doc_id: r.text for r in got}[10**6] == ""
            assert [(r.n_tokens, r.text) for r in got if r.doc_id is None and r.n_tokens == 0] == [(0, "")]
            continue
        assert out.columns == docs.columns == none.columns, name
        ids = [r.doc_id for r in got]
        if name == "language_id":
            assert 10**6 not in ids and 10**6 + 1 in ids and ids.count(None) == 1
        else:
            assert 10**6 in ids and 10**6 + 1 in ids and ids.count(None) == 2, name
        if name == "near_duplicates":
            assert len({(r.doc_id, r.text) for r in got}) == len(got)
        if name == "personal_data":
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_word_hashes_tell_rows_apart():
    import pyarrow as pa

    column = pa.array(["ab c", "d", None, "", "e f ab", "ab"])
    for a, b, data, offsets in wordhash.text_chunks(column, 10**6):
        w = wordhash.Words(data, offsets, wordhash.WHITE)
        assert (a, b) == (0, 6) and w.counts.tolist() == [2, 1, 0, 0, 3, 1]
        h = w.hashes()
        assert h[0] == h[5] == h[6] and len(set(h.tolist())) == 5
    assert zlib.crc32(b"") == 0 and os.path.exists(public_tokenizers.path("piece_bpe_32k.model"))
