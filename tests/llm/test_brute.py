"""Operators against plain versions of what they say they do."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from roamspark.llm import compaction, ctw, decontaminate, dedup, gru, kit, language, minhash, packing, quality, scoring, suffixes, toxicity, warc
from roamspark.llm import queries as registered

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        mask = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                mask[p] += 1
                mask[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(mask)[: len(t)] > 0
        out[i] = len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT", hot)
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(4)]
    rows = list(texts.items()) if hot == 4096 else []
    for i in range(1000, 1080):
        t = ""
        for _ in range(rng.randint(0, 5)):
            k = rng.random()
            s = rng.randint(0, 300)
            t += rng.choice(base)[s : s + rng.randint(50, 300)] if k < 0.4 else rng.choice("xy") * rng.randint(1, 300) if k < 0.6 else ("the " + rng.choice("pq")) * rng.randint(1, 60) if k < 0.8 else "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(1, 300)))
        rows.append((i, t))
    got = dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = repeats([(i, t.encode()) for i, t in rows])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_dedup_of_repeated_ids(spark):
    """Texts of one id, null ones too, are told apart, ordered by their hash; equal ones of an id are one document."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = [(None if k % 3 else 5, f"{rng.random()} {base[s : s + 250]} {rng.random()}") for k in range(1500) for s in [rng.randrange(350)]]
    rows += rows[:3] + [(None, None), (None, "")]
    got = dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    key = lambda i, t: (-1 if i is None else i, int(dedup.text_hash(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]), t)
    texts = sorted({key(i, (t or "").encode()) for i, t in rows})
    want = repeats([(k, t) for k, (_, _, t) in enumerate(texts)])
    at = {(i, hashlib.sha256(t).hexdigest()): want[k] for k, (i, _, t) in enumerate(texts)}
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *at[key(i, (t or "").encode())[0], hashlib.sha256((t or "").encode()).hexdigest()]) for i, t in rows)


def test_remaining_text_keeps_characters():
    body = "aé€b".encode()  # 1, 2, 3 and 1 bytes
    for s in range(len(body)):
        for e in range(s + 1, len(body) + 1):
            whole = "".join(c for c, a, b in (("a", 0, 1), ("é", 1, 3), ("€", 3, 6), ("b", 6, 7)) if a < s or b > e)
            assert dedup.as_text(body, ([s], [e])) == whole


def test_pieces_of_long_texts(monkeypatch):
    data = np.frombuffer(("abc" * 50 + "def" * 70 + "x1y2z3" * 90).encode() * 3, np.uint8)
    offs = np.array([0, len(data)])
    whole = dedup.contexts_of(data, offs)
    monkeypatch.setattr(dedup, "PIECE", 400)
    cut = dedup.contexts_of(data, offs)
    spread = lambda c: sorted((int(at) + k, int(at) + int(a) - 0, int(h)) for at, a, n, h in zip(c[1], c[2], c[3], c[4]) for k in range(int(n) + 1))
    assert [x[0] for x in spread(whole)] == [x[0] for x in spread(cut)] == list(range(len(data) - 99))


def test_difference_cover():
    assert {(int(a) - int(b)) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.V))
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(150)) for _ in range(4)]
    blocks = [rng.choice(parts)[rng.randint(0, 9) : 140] for _ in range(12)]
    blocks = [b[:130] for b in blocks]
    data = np.frombuffer("".join(blocks).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, blocks)])
    text, start, cls = suffixes.classes(data, bounds, np.zeros(len(blocks), int), 100)
    windows = [(blocks[t][s : s + 100], s % suffixes.V) for t, s in zip(text, start)]
    assert len(set(zip(cls.tolist(), windows))) == len(set(cls.tolist())) == len(set(windows))


def test_ctw_is_what_the_recursion_says():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abac", np.uint8), 300)
    depth = 2
    grams, bounds = ctw.grams_of(data, np.array([0, 120, 300]), depth)
    assert bounds.tolist() == [0, 121, 302]
    keys, n = np.unique(grams, return_counts=True)
    counts = defaultdict(lambda: [0, 0])
    for g, c in zip(keys.tolist(), n.tolist()):
        byte, ctx = g & 255, (g >> 8).to_bytes(depth, "big")
        for d in range(depth + 1):
            for i in range(8):
                counts[ctx[depth - d :], 1 << i | byte >> (8 - i)][byte >> (7 - i) & 1] += c
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(ctx, node):
        if len(ctx) == depth:
            return kt(*counts[ctx, node])
        longer = [c for c, m in list(counts) if m == node and len(c) == len(ctx) + 1 and c[1:] == ctx]
        return float(np.logaddexp(kt(*counts[ctx, node]), sum(pw(c, node) for c in longer)) - math.log(2))

    def p(ctx, d, node, bit):
        own = ctx[depth - d :]
        if (own, node) not in counts:
            return None
        a, b = counts[own, node]
        here = ((b if bit else a) + 0.5) / (a + b + 1)
        deeper = p(ctx, d + 1, node, bit) if d < depth else None
        if deeper is None:
            return here
        w = math.exp(kt(a, b) - math.log(2) - pw(own, node))
        return w * here + (1 - w) * deeper

    tree, _ = ctw.Tree.build(keys, n.astype(float), depth)
    low, (up, total) = ctw.Tree.build(keys, n.astype(float), depth, 2)
    short, inverse = np.unique(keys & ctw.mask(1), return_inverse=True)
    top, _ = ctw.Tree.build(short, np.bincount(inverse, n).astype(float), 1, 0, (up, total))
    asked = np.array([*keys[:10], int.from_bytes(b"abz", "big"), int.from_bytes(b"zza", "big"), int.from_bytes(b"zab", "big")], np.uint64)
    want = []
    for g in asked.tolist():
        byte, ctx, bits = g & 255, (g >> 8).to_bytes(depth, "big"), 0.0
        for i in range(8):
            q = p(ctx, 0, 1 << i | byte >> (8 - i), byte >> (7 - i) & 1)
            bits -= math.log2(0.5 if q is None else q)
        want.append(bits)
    assert np.allclose(tree.bits(asked), want, rtol=1e-4) and np.allclose(low.bits(asked, top), want, rtol=1e-4)
    every = np.array([int.from_bytes(b"ab", "big") << 8 | b for b in range(256)], np.uint64)
    assert abs((2 ** -tree.bits(every)).sum() - 1) < 1e-4


def test_slots_hold_all_keys():
    keys = np.unique(np.concatenate([np.array([0, 1, 2], np.uint64), np.random.default_rng(3).integers(0, 1 << 48, 5000).astype(np.uint64)]))
    held, other = keys[::2], keys[1::2]
    slots = scoring.Slots(held, np.arange(len(held), dtype=np.float32))
    value, seen = slots.find(keys)
    assert seen.tolist() == np.isin(keys, held).tolist() and value[::2].tolist() == list(range(len(held))) and not value[1::2].any()
    assert not scoring.Slots(other[:0], np.zeros(0, np.float32)).find(keys)[1].any()


@pytest.mark.parametrize("most", [1_000_000, 40, 0])
def test_score_is_of_the_whole_tree(spark, monkeypatch, most):
    """Scores do not depend on any bound of train(); grams beyond the given code lengths, also unseen ones, are found in the tree."""
    monkeypatch.setattr(scoring.train, "__defaults__", (scoring.DEPTH, *[most] * (len(scoring.train.__defaults__) - 1)))
    rng = random.Random(4)
    line = lambda k: " ".join(rng.choice(["abra", "cadabra", "bar", "zoë", f"n{rng.randrange(k)}"]) for _ in range(30))
    rows = [(i, line(40)) for i in range(30)]
    seen, asked = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows[:20], rows + [(90, "never qqq seen"), (91, None), (None, "abra")]))
    got = {r.doc_id: r.score for r in scoring.score(asked, scoring.train(seen), scoring.token_counts(seen)).collect()}
    put = lambda texts: (lambda b: ctw.grams_of(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]), scoring.DEPTH)[0])([x.encode() for x in texts])
    keys, n = np.unique(put([t for _, t in rows[:20]]), return_counts=True)
    tree, _ = ctw.Tree.build(keys, n.astype(float), scoring.DEPTH)
    for i, t in [*rows, (90, "never qqq seen"), (91, ""), (None, "abra")]:
        assert math.isclose(got[i], tree.bits(put([t])).sum() * -math.log10(2), rel_tol=1e-4)


@pytest.mark.parametrize("most", [500_000, 50])
def test_base_score(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(scoring.frequent, "__defaults__", (most,))
    rows = {r.doc_id: r for r in scoring.op2_score(spark, SMALL).collect()}
    words = {i: [w.translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))) for w in t.encode().split()] + [b"\xff"] for i, t in texts.items()}
    held = Counter()
    for i, w in words.items():
        if kit.crc_fold(i, 7) != 2:
            held.update(w)
    n, v = sum(held.values()), len(held)
    for i, w in words.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in held for x in w), n, kit.crc_fold(i, 7) == 2)
        assert math.isclose(r.base_score, sum(math.log10((held[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    rows = packing.pack(docs).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], np.uint32) for i, x in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0


def test_neighbours_share_a_window():
    a, b = np.arange(100, 500, dtype=np.uint32), np.arange(5000, 5400, dtype=np.uint32)
    out = packing.pack_shard([a, b, a[::-1].copy(), b[::-1].copy(), a + 0, b + 0])
    assert [[k for k, _, _ in s] for s in out][0] == [0, 2, 4]


def test_bm25_ranks_as_counting_does():
    rng = np.random.default_rng(6)
    rests = [rng.choice(60, rng.integers(5, 80), p=np.arange(60, 0, -1) / 1830).astype(np.uint32) for _ in range(40)]
    mean = sum(map(len, rests)) / len(rests)
    df = Counter(t for r in rests for t in set(r.tolist()))

    def bm25(query, doc):
        tf = Counter(doc.tolist())
        idf = {t: math.log(1 + (len(rests) - df[t] + 0.5) / (df[t] + 0.5)) for t in set(query.tolist())}
        return sum(w * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(doc) / mean)) for t, w in idf.items() if t in tf)

    index = packing.Index(rests)
    for k in range(len(rests)):
        assert np.allclose(index.scores(k), [bm25(rests[k], r) for r in rests])
    first = packing.pack_shard(rests, 200)[0]
    best = sorted(range(1, len(rests)), key=lambda d: -bm25(rests[0], rests[d]))
    assert [d for d, _, _ in first] == [0, *best[: len(first) - 1]]


def test_packing_does_not_depend_on_tasks(spark, docs, monkeypatch):
    """What is packed together follows from the rows, over several ranges and shards."""
    monkeypatch.setattr(packing, "RANGE", 2)

    def packed(rows):
        out = defaultdict(list)
        for r in packing.pack(rows, shard=16).collect():
            out[r.sequence_id].append((r.offset, r.doc_id, r.start, r.length))
        return sorted(tuple(sorted(x)) for x in out.values()), {k for k in out if k >= packing.PACKED}

    one, two = packed(docs.repartition(2)), packed(docs.repartition(8))
    assert one == two and len({k >> 36 for k in one[1]}) > 3


def test_special_text_is_encoded_as_tokenizers_does():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    odd = ["a<|endoftext|>b", "", " x  y\n\n é漢字 don't", "  z"]
    assert packing.encoder(packing.tokenizer_path())(odd) == [t.encode(x, add_special_tokens=False).ids for x in odd]


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_sql(agree, name):
    agree(registered.queries()[name], registered.oracle_sql()[name])


def test_decontaminate_in_blocks_and_spans(docs, spark, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.contamination(docs, bench, max_windows=100).collect()}
    assert one == many and any(r.hits for r in one.values())
    for i, r in one.items():
        words = decontaminate.words_of(texts[i].encode())
        for h, s in zip(r.hits, r.spans):
            assert decontaminate.words_of(texts[i].encode()[s.start : s.stop]) == words[h["first"] : h["last"]]


def test_compaction_versions(spark, docs, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = compaction.shard_table(docs, root, arrival=8, base=20_000, fan=2, target=100_000)
    assert rows.groupBy("run").agg(F.countDistinct("arrival").alias("k")).agg(F.max("k")).first()[0] > 1
    assert compaction.latest(spark, root) == 2
    with pytest.raises(FileExistsError):
        compaction.commit(spark.range(1).toDF("path"), root, 2)
    assert compaction.latest(spark, root) == 2
    before = sorted(r.doc_id for r in rows.select("doc_id").collect())
    assert compaction.vacuum(spark, root) > 0
    assert sorted(r.doc_id for r in compaction.read_manifest(spark, root, compaction.sized(docs, "doc_id", "text", 8)).select("doc_id").collect()) == before


def test_compaction_is_native(spark, docs, tmp_path):
    plan = compaction.shard_table(docs, f"file://{tmp_path}/n")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    more = pages.unionByName(pages.limit(9).withColumn("page_id", F.col("page_id") + 10_000)).unionByName(spark.sql("select 7000L page_id, 'u' url, cast(null as string) html union all select 7001L, null, ''"))
    got = {r.record_id: r for r in warc.read_archives(warc.write_archives(warc.planned(more), warc.dictionary_for(more), 50_000), True).collect()}
    held = {f"<urn:page:{r.page_id}>": (r.html or "").encode() for r in more.collect()}
    assert set(got) == set(held)
    first = {}
    for k, body in sorted(held.items(), key=lambda x: int(x[0][10:-1])):
        first.setdefault(body, k)
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.sha1_base32(body))
        assert (r.record_type, r.refers_to) == (("response", None) if first[body] == k else ("revisit", first[body]))
        assert r.payload == (bytearray(body) if first[body] == k else None)
    for r in warc.write_archives(warc.planned(more), warc.dictionary_for(more)).collect():
        (tmp_path / r.archive).write_bytes(r.content)
    assert warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).count() == len(held)


def test_warc_rejects_damage():
    good = warc.record(1, "u", b"body")
    assert warc.parse(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC Date"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)
    import zstandard

    frame = zstandard.ZstdCompressor().compress(good)
    assert warc.frame_end(frame + b"x", 0) == len(frame)
    with pytest.raises(ValueError):
        list(warc.records_of(frame[:-3]))


def test_language_held_out(spark):
    rows = language.op8_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97 and sum(r.rejected for r in rows) == 0


def test_kneser_ney_sums_to_one():
    words = ["abra", "cadabra", "bar", "cab"] * 3 + ["a"]
    m = language.Model.fit(list(dict.fromkeys(words)), [words.count(w) for w in dict.fromkeys(words)], 3)
    ends = "abcdr "
    p = 0.0
    for c in ends:  # what follows "ab" at the start of a word
        g, ctx, longest, _ = language._grams([("ab" + c).strip()], 3)
        p += 2 ** -m.bits(g, ctx, longest)[2]
    assert 0.9 < p <= 1.0
    assert language.Scorer([m]).texts(np.frombuffer(b"zzzz qqqq", np.uint8), np.array([0, 9]))[0, 0] / 10 > 5


def plain_kneser_ney(words, order):
    """Bits of a word by dictionaries of counts."""
    spots = [(f" {w} ", i, n) for w, n in words.items() for i in range(1, len(w) + 2)]
    tables = {}
    for k in range(order, 0, -1):
        count = Counter()
        for w, i, n in spots:
            if min(i + 1, order) == k:
                count[w[i - k + 1 : i + 1]] += n
        if k < order:
            for longer in {w[i - k : i + 1] for w, i, _ in spots if min(i + 1, order) > k}:
                count[longer[1:]] += 1
        n1, n2 = (sum(v == x for v in count.values()) for x in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
        total, kinds = Counter(), Counter()
        for g, v in count.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        tables[k] = {g: (v - d) / total[g[:-1]] for g, v in count.items()}, {c: d * kinds[c] / t for c, t in total.items()}

    def bits(word):
        w, out = f" {word} ", 0.0
        for i in range(1, len(w)):
            p = 1 / (len(tables[1][0]) + 256)
            for k in range(1, min(i + 1, order) + 1):
                prob, back = tables[k]
                if (c := w[i - k + 1 : i]) in back:
                    p = prob.get(w[i - k + 1 : i + 1], 0.0) + back[c] * p
            out -= math.log2(p)
        return out

    return bits


def test_kneser_ney_is_what_counting_says(texts):
    words = Counter(w for t in list(texts.values())[:40] for w in "".join(c if c.isalpha() else " " for c in t.lower()).split())
    m, plain = language.Model.fit(list(words), list(words.values())), plain_kneser_ney(words, language.ORDER)
    asked = [*list(words)[:200], "zzz", "thé", "q", "unseenword"]
    got = language.Scorer([m]).words(asked)
    assert np.allclose(got[:, 0], [plain(w) for w in asked], rtol=1e-4) and got[:, 1].tolist() == [len(w) + 1 for w in asked]


def test_languages_in_blocks(spark, docs, monkeypatch):
    """Scoring a language at a time gives what all at once give; every labelled language is learned."""
    rows = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 3).cast("string")))
    want = {r.doc_id: r for r in language.identify(docs, language.fit(rows)).collect()}
    monkeypatch.setattr(language, "BLOCK", 5)
    who = language.fit(rows)
    assert who.langs == sorted({r.lang for r in rows.select("lang").collect()}) and len(who.langs) > 10
    for r in language.identify(docs, who).collect():
        w = want[r.doc_id]
        assert (r.lang_pred, r.rejected) == (w.lang_pred, w.rejected) and math.isclose(r.score, w.score, rel_tol=1e-9) and math.isclose(r.bits, w.bits, rel_tol=1e-9)


def test_language_sample_of_repeated_ids(spark):
    """Rows without an id are drawn by their texts, equal ones once."""
    rows = [(None, f"{a} {b} one two three", "xx") for a in "abcdefghij" for b in "klmnopqrst"] * 2 + [(1, "vier fünf sechs", "yy")]
    who = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20)
    assert who.langs == ["xx", "yy"]


def edits(a, b):
    """The edit distance of two lists, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def close(a, b, least=0.8):
    """Whether two lists of words have the edit similarity least or more; common words are counted first, as the table is slow."""
    w = max(len(a), len(b))
    if w and sum((Counter(a) & Counter(b)).values()) < least * w - 1e-9:
        return False
    return not w or edits(a, b) <= (1 - least) * w + 1e-9


def grouped(texts, linked):
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and linked(texts[a], texts[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_minhash_classes(spark, docs, texts):
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    want = grouped({i: t.lower().split() for i, t in texts.items()}, close)
    assert got == want and len(set(want.values())) < len(want)


def test_minhash_recall(spark):
    """Edited copies of a thousand texts, against all pairs: every tenth word replaced, dropped or added at most."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = {}
    for i in range(0, 1000, 2):
        rows[i] = [word() for _ in range(rng.randint(20, 120))]
        rate = rng.uniform(0, 0.12)
        rows[i + 1] = [x for w in rows[i] for x in ([w] if rng.random() >= rate else rng.choice([[], [word()], [w, word()]]))]
    sets = {i: Counter(t) for i, t in rows.items()}
    want = {(a, b) for a in rows for b in rows if a < b and sum((sets[a] & sets[b]).values()) >= 0.8 * max(len(rows[a]), len(rows[b])) - 1e-9 and close(rows[a], rows[b])}
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], "doc_id long, text string")).collect()}
    found = [got[a] == got[b] for a, b in want]
    assert len(found) > 450 and sum(found) / len(found) > 0.98
    assert all((c, i) in want for i, c in got.items() if c != i)


@pytest.mark.parametrize(("small", "length", "rare"), [(16, 140, 16), (2, 140, 16), (2, 240, 0)])
def test_minhash_pairs_in_buckets_of_others(spark, monkeypatch, small, length, rare):
    """Texts of one passage and words of their own share keys made of the passage; each pair of close ones is found all the same."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "RARE", rare)
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(length)]
    rows = []
    for i in range(60):
        own = [f"w{rng.randrange(10**9)}" for _ in range(70)]
        near = own[: -30 if rare else -6] + [f"w{rng.randrange(10**9)}" for _ in range(30 if rare else 6)]
        rows += [(1000 + i, passage[: 140 if rare else 60] + own), (2000 + i, passage[: 140 if rare else 60] + near)]
    want = grouped(dict(rows), close)
    assert len(set(want.values())) == 60
    rows = sorted(((i, " ".join(t)) for i, t in rows), key=lambda r: zlib.crc32(str(r).encode()))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_short_texts(spark):
    """Short texts that differ in a fifth of their words, wherever those stand, are all linked; so are most long ones."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = {}
    for i in range(400):
        text = [word() for _ in range(5 + i % 36)]
        most = len(text) // 5
        places = rng.sample(range(len(text)), most) if i % 2 else [5 * k + 4 - (i // 2) % 5 for k in range(most)]
        rows[2 * i], rows[2 * i + 1] = text, [word() if k in places else x for k, x in enumerate(text)]
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], "doc_id long, text string")).collect()}
    found = {i: got[2 * i] == got[2 * i + 1] for i in range(400)}
    assert all(v for i, v in found.items() if len(rows[2 * i]) <= minhash.SHORT) and sum(found.values()) > 0.95 * len(found)


def test_minhash_all_pairs_of_a_large_bucket(spark, monkeypatch):
    """Copies of a passage, edited far below the shingle similarity of THRESHOLD: with neither centres nor turns each link of a large bucket is found."""
    monkeypatch.setattr(minhash, "RARE", 0)
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(100)]
    rows = {}
    for i in range(60):
        own = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        rows[1000 + i] = passage + own
        rows[2000 + i] = passage + [f"w{rng.randrange(10**9)}" if k % 3 == 0 else x for k, x in enumerate(own)]
    want = grouped(rows, close)
    assert len(set(want.values())) == 60
    labels = spark.createDataFrame([(1000, 1000), (2000, 1000)], "node long, label long")
    texts = spark.createDataFrame([(i, zstandard.compress(" ".join(t).encode())) for i, t in rows.items()], "node long, text binary")
    pairs = {(r.a, r.b) for r in minhash._close(texts, labels).collect()}
    assert {(1000 + i, 2000 + i) for i in range(1, 60)} <= pairs


def test_pairs_of_one_repeated_word_pair_are_made_once(spark, monkeypatch):
    """Texts that share many words of the prefix filter make one row a pair, not one for each word; none that shares THRESHOLD of its words is lost."""
    rng = random.Random(6)
    rows = {i: [f"w{rng.randrange(10**9)}" for _ in range(36 + i % 3)] + ["is", "here"] * (80 + i % 7) for i in range(40)}
    texts = spark.createDataFrame([(i, zstandard.compress(" ".join(t).encode())) for i, t in rows.items()], "node long, text binary")
    labels = spark.createDataFrame([], "node long, label long")
    monkeypatch.setattr(type(texts), "distinct", lambda self: self)
    got = [(r.a, r.b) for r in minhash._close(texts, labels).collect()]
    kinds = {i: Counter(t) for i, t in rows.items()}
    want = {(a, b) for a in rows for b in rows if a < b and (kinds[a] & kinds[b]).total() >= minhash.THRESHOLD * max(len(rows[a]), len(rows[b])) - 1e-6}
    assert len(want) > 300 and want <= set(got) and len(got) < 1.5 * len(set(got))


def test_turns_ask_again_only_where_links_were_found(spark, monkeypatch):
    """A turn after the first takes words of components that the last one joined, not those of all texts."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(8)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = [f"p{k}" for k in range(100)]
    rows = {}
    for i in range(60):
        words = own(100)
        rows |= {1000 + i: passage + words, 2000 + i: passage + ([own(1)[0] if k % 3 == 0 else x for k, x in enumerate(words)] if i < 20 else own(100))}
    asked, turn = [], minhash._turn

    def counted(rare, labels, k):
        asked.append(rare.count())
        return turn(rare, labels, k)

    monkeypatch.setattr(minhash, "_turn", counted)
    texts = sorted(((i, " ".join(t)) for i, t in rows.items()), key=lambda r: zlib.crc32(str(r).encode()))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == grouped(rows, close)
    assert len(asked) > 1 and all(n < 0.6 * asked[0] for n in asked[1:])


def test_prefixes_of_words_that_meet(spark):
    """Words that only texts of one label, or of lengths too far apart, have are not moved; all pairs of different labels with THRESHOLD of the longer one's words in common still meet."""
    rng = random.Random(4)
    rows, label = {}, {}
    for i in range(40):  # copies under one label, and texts three times as long that hold the same words
        words = [f"a{i}x{k}" for k in range(50)]
        rows |= {10 * i: words, 10 * i + 1: words[:-1], 10 * i + 2: words + [f"b{i}x{k}" for k in range(100)]}
        label |= {10 * i: 10 * i, 10 * i + 1: 10 * i, 10 * i + 2: 10 * i + 2}
    few = list(rows)
    for i in range(60):
        size = rng.randrange(5, 400)
        words = [f"c{rng.randrange(300)}" if rng.random() < 0.3 else f"d{rng.randrange(10**9)}" for _ in range(size)]
        cut = rng.randrange(size // 5 + 1)
        rows |= {1000 + i: words, 2000 + i: words[cut:]}
        label |= {1000 + i: 1000 + i, 2000 + i: 2000 + i}
    table = lambda ids: spark.createDataFrame([(i, zstandard.compress(" ".join(rows[i]).encode()), label[i], True) for i in ids], "node long, text binary, label long, out boolean")
    assert minhash.prefixes(table(few)).count() <= 40  # cells shared by chance
    marked = lambda t: set(Counter((w, k) for w in set(t) for k in range(t.count(w))))
    kinds = {i: marked(t) for i, t in rows.items()}
    want = {(a, b) for a in rows for b in rows if a < b and label[a] != label[b] and len(kinds[a] & kinds[b]) >= minhash.THRESHOLD * max(len(rows[a]), len(rows[b])) - 1e-6}
    got = {(r.a, r.b) for r in minhash._close(table(rows).select("node", "text"), spark.createDataFrame(list(label.items()), "node long, label long")).collect()}
    assert len(want) >= 60 and want <= got


def test_components_grow(spark):
    from roamspark.llm import components

    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    table = lambda rows: spark.createDataFrame([(a, b) for a, b in rows if a != b], "a long, b long")
    labels = components.components(table(links[:15]))
    for k in (15, 30):
        labels = components.extended(labels, table(links[k : k + 15]))
    assert {r.node: r.label for r in labels.collect()} == {r.node: r.label for r in components.components(table(links)).collect()}


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randrange(4) for _ in range(rng.randrange(24))]
        b = [x for x in a for x in ([x] if rng.random() > 0.2 else rng.choice([[], [rng.randrange(4)], [x, rng.randrange(4)]]))] if rng.random() < 0.8 else [rng.randrange(4) for _ in range(rng.randrange(24))]
        most = rng.randrange(9)
        assert minhash.distance(a, b, most) == min(edits(a, b), most + 1)
    text = lambda *w: minhash.Text(" ".join(w).encode())
    words = [f"w{k}" for k in range(100)]
    assert minhash.similar(text(*words), text(*words[:40], "x", *words[41:])) and not minhash.similar(text(*words), text(*words[50:], *words[:50]))
    assert minhash.similar(text(*words), text(*words[20:])) and not minhash.similar(text(*words), text(*words[21:])) and minhash.similar(text(), text())


def test_minhash_repeated_ids(spark):
    """Null and repeated ids do not bring different texts together, nor does a class lose its row."""
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    same, rows = line(), []
    rows += [(None, line(), "a") for _ in range(20)] + [(7, line(), "b") for _ in range(20)] + [(i, same, "c") for i in (9, 8, None)] + [(None, None, "d"), (None, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = minhash.near_classes(docs)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == Counter({(None, None, 1): 20, (7, 7, 1): 20, (9, 8, 3): 1, (8, 8, 3): 1, (None, 8, 3): 1, (None, None, 2): 2})
    kept = [(r.doc_id, r.text, r.node) for r in minhash.distinct(docs, carry=["node"]).collect()]
    assert Counter(k for k in kept if k[2] != "d") == Counter([*rows[:40], (8, same, "c")]) and [k[0] for k in kept if k[2] == "d"] == [None]


def test_quality_base(docs, texts, spark):
    rows = quality.op10_quality(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        words = t.encode().split()
        lines = t.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if x.encode().split() and x in lines[:k])
        w5 = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {k + d for k in range(len(words) - 4) if w5[tuple(words[k : k + 5])] > 1 for d in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit))
        assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words)) and r.kept == (not r.base_failed and r.log_ratio >= quality.THRESHOLD)


def test_quality_ratio(docs, texts, spark):
    """Mean log ratios by the plain definition, with a bucket for each n-gram's hash."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")
    good = {r.doc_id for r in labels.collect()}
    grams = {}
    for i, t in texts.items():
        data = np.frombuffer(t.encode(), np.uint8)
        _, _, _, _, one, pair, inner = quality._grams(data, np.array([0, len(data)])) if len(data) else (0, 0, 0, 0, np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
        grams[i] = [*one.tolist(), *pair[inner].tolist()]
    raw, trusted = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in good:
            trusted.update(g)
    k = sum(trusted.values()) / sum(raw.values())
    for r in quality.measure(docs, quality.fit(docs, labels)).collect():
        want = np.mean([math.log((trusted[b] + quality.SMOOTH) / (raw[b] * k + quality.SMOOTH)) for b in grams[r.doc_id]] or [0.0])
        assert abs(r.log_ratio - want) < 1e-4


def test_gradients():
    """One step against finite differences of the loss."""
    net = gru.Net(3)
    w = gru.Words([b"you are bad bad words", b"good day to you all of you"])
    rows = [w.window(0, 0), w.window(1, 0)]
    ids, mask = gru._grid(rows, np.concatenate(rows))
    y, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        logit = net.run(net.projected(net.inputs(w.words, w.grams, w.gram_bounds)), ids, mask)
        return float(np.logaddexp(0, np.where(y > 0, -logit, logit)).mean())

    for name, at in (("uf", (1, 5)), ("ub", (0, 17)), ("wf", (2, 9)), ("cb", (3,)), ("att", (2, 1)), ("score", (0,)), ("out", (4,)), ("word", (int(w.words[0]), 1)), ("gram", (int(w.grams[3]), 2))):
        held = {k: v.copy() for k, v in net.p.items()}
        slope = []
        for e in (1e-2, -1e-2):
            net.p[name][at] = held[name][at] + e
            slope.append(loss())
        net.p = {k: v.copy() for k, v in held.items()}
        square = {k: np.zeros_like(v) for k, v in net.p.items()}
        net.square = {k: v + 1e-12 for k, v in square.items()}
        net.step(w.words, w.grams, w.gram_bounds, ids, mask, y, weight, 0.0)
        got = math.sqrt(max(float(net.square[name][at]) - 1e-12, 0))
        assert abs(got - abs(slope[0] - slope[1]) / 2e-2) < 2e-3 + 0.05 * got, name
        net.p = held


def test_forward_pass_is_what_the_equations_say():
    """Scores of windows, a word and a hidden unit at a time."""
    net, rng = gru.Net(3), np.random.default_rng(4)
    net.word_odds[:], net.gram_odds[:] = rng.standard_normal(len(net.word_odds)), rng.standard_normal(len(net.gram_odds))
    words = [b"abra", b"x", b"cadabra", b"z\xc3\xa9ro"]
    data = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8)
    starts, ends, _ = kit.tokens(data, np.array([0, len(data)]))
    word, grams, bounds = gru.word_features(data, starts, ends)
    gates = net.projected(net.inputs(word, grams, bounds))
    ids, mask = np.array([[0, 1, 2], [3, 3, 0]]), np.array([[True, True, True], [True, False, False]])
    got = net.run(gates, ids, mask)
    sig, p, n = (lambda x: 1 / (1 + math.exp(-x))), net.p, gru.HIDDEN

    def inputs(k):
        own = grams[bounds[k] : bounds[k + 1]].tolist()
        mean = [sum(float(p["gram"][g][c]) for g in own) / max(len(own), 1) for c in range(gru.DIM)]
        odds = [float(net.gram_odds[g]) for g in own]
        return [*map(float, p["word"][word[k]]), *mean, float(net.word_odds[word[k]]), sum(odds) / max(len(odds), 1), max(odds, default=0.0)]

    def direction(seq, d):
        h, out = [0.0] * n, []
        for k in seq if d == "f" else seq[::-1]:
            v = inputs(k)
            x = [sum(v[i] * float(p["w" + d][i, j]) for i in range(len(v))) + float(p["c" + d][j]) for j in range(3 * n)]
            g = [sum(h[i] * float(p["u" + d][i, j]) for i in range(n)) for j in range(3 * n)]
            z, r = [sig(x[j] + g[j]) for j in range(n)], [sig(x[n + j] + g[n + j]) for j in range(n)]
            new = [math.tanh(x[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
            out.append(h)
        return out if d == "f" else out[::-1]

    for row, seq in enumerate([[0, 1, 2], [3]]):
        states = [a + b for a, b in zip(direction(seq, "f"), direction(seq, "b"))]
        e = [sum(math.tanh(sum(s[i] * float(p["att"][i, j]) for i in range(2 * n))) * float(p["score"][j]) for j in range(gru.ATT)) for s in states]
        total = sum(map(math.exp, e))
        pooled = [sum(math.exp(w) / total * s[i] for w, s in zip(e, states)) for i in range(2 * n)]
        assert math.isclose(got[row], sum(x * float(o) for x, o in zip(pooled, p["out"])) + float(p["bias"][0]), rel_tol=1e-3, abs_tol=1e-4)


def test_features_of_many_words_stay_small(monkeypatch):
    """n-grams of all distinct words are never worked out at once, and blocks give what one block does."""
    words = [f"word{k * 7919}of{k}" for k in range(20_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    net, peaks = gru.Net(3), []
    gru.word_features(data, starts[:9000], ends[:9000])
    for call in (lambda: gru.word_features(data, starts, ends), lambda: net.inputs(*got)):
        tracemalloc.start()
        got = call() if not peaks else got
        inputs = call() if peaks else None
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[0] < 50e6 and peaks[1] < 15e6, peaks
    monkeypatch.setattr(gru, "BLOCK", 1 << 20)
    for a, b in zip((*got, inputs), (*gru.word_features(data, starts, ends), net.inputs(*got))):
        assert np.array_equal(a, b)


def test_contradictory_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'good'} word {k}") for k in range(40)], "doc_id long, text string")
    held = [(k, k % 2) for k in range(38)] + [(38, 0), (38, 1), (39, 1), (39, 1)]
    seen = []
    original, gru.fit = gru.fit, lambda texts, y, share: seen.append((sorted(texts), y.sum(), share))
    try:
        toxicity.fit(docs, spark.createDataFrame(held, "doc_id long, toxic int"))
    finally:
        gru.fit = original
    texts, ones, share = seen[0]
    assert len(texts) == 39 and b"good word 38" not in texts and ones == 20 and abs(share - 20 / 39) < 1e-9


def test_windows_cover_all_words():
    for n in (0, 1, gru.WINDOW, gru.WINDOW + 1, 1000):
        seen = {k for s in gru.windows(n) for k in range(s, min(s + gru.WINDOW, n))}
        assert seen == set(range(n))


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.01"
    rows = toxicity.op5_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.85


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert new.columns == cp.COLUMNS
        if name == "near_copies":
            assert {r.doc_id for r in new.collect()} == {r.class_id for r in minhash.near_classes(docs).collect()}
        if name == "repeats":
            want = {i: w[3] for i, w in repeats([(r.doc_id, r.text.encode()) for r in docs.collect()]).items()}
            assert new.count() == docs.count() and sum(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] for r in new.collect()) > 0.95 * new.count()
        if name == "benchmark":
            assert not any(r.hits for r in decontaminate.contamination(new, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect())
        docs = new
    assert 0 < docs.select("doc_id").distinct().count() <= before
    assert cp.run(spark, SMALL).count() == docs.count()
