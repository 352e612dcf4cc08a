"""Every operator on a small table of odd rows, against a plain loop or an exact round trip."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from typeahead.llm import (arc_to_warc, binpack, byte_shards, context_coder, crf_langid, exact_dedup,
                           kneser_ney, phrase_index, simhash_vp, tag_paths)

SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from home"
TEXTS = [None, "", "   ", "Word", "word", SENTENCE, SENTENCE.upper(), SENTENCE + " today", SENTENCE, "ÄÖ ä b c d e",
         "x " * 3000 + SENTENCE, "a,b;c 1 2 3 " + SENTENCE + ".", "<|endoftext|> tail", "日本語 \x1c text", "éa éa éa"]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)]
    return found + [found[5], (None, "no id", None), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns that clash with names the operators use inside
    return spark.createDataFrame([r + (1, "z", 2) for r in rows],
                                 "doc_id long, text string, lang string, id int, h string, n int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return (t or "").encode().lower()


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.exact_dedup(docs, digest_singles=True).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(sha) and set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_shards(docs, rows, empty):
    got = sorted(byte_shards.byte_shards(docs, 4).collect(), key=lambda r: (r.shard, r.slot))
    assert len(got) == len(rows) and byte_shards.byte_shards(empty, 4).count() == 0
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    total, before, slots = sum(r["size"] for r in got), 0, Counter()
    for r in got:
        assert r.shard == min(before * 4 // total, 3) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        before += r["size"]
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        if r.doc_id is not None:
            raw = (by_id[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def token_ids(text, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(binpack.tokenizer_file())
    return tok.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, rows, empty):
    got = binpack.pack_documents(docs, binpack.tokenizer_file(), seq_len=64, group_pieces=20).collect()
    assert binpack.pack_documents(empty, binpack.tokenizer_file()).count() == 0
    ids = {i: token_ids(t, 0) for i, t, _ in rows if i is not None}
    spans, bins = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            assert r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length])
            spans[r.doc_id].append((r.start, r.length))
    for i, want in ids.items():
        copies = 2 if i == 5 else 1
        assert sum(n for _, n in spans[i]) == copies * len(want)
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 100, 400))[::-1]
    bins, offsets = binpack.first_fit_decreasing(lengths, 100)
    room = []
    for n, b, o in zip(lengths, bins, offsets):
        want = next((i for i, r in enumerate(room) if r >= n), len(room))
        if want == len(room):
            room.append(100)
        assert (b, o) == (want, 100 - room[want])
        room[want] -= n


def test_id_files(docs, rows, empty):
    files = context_coder.write_id_files(docs, binpack.tokenizer_file())
    got = context_coder.read_id_files(files).collect()
    assert len(got) == len(rows)
    assert context_coder.read_id_files(context_coder.write_id_files(empty, binpack.tokenizer_file())).count() == 0
    want = {(i, len(x), crc(x)) for i, t, _ in rows for x in [token_ids(t, 2)]}
    assert {(r.id, r.n_tokens, r.ids_crc32) for r in got} == want
    pos = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == pos
        pos += r.n_tokens


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for blocks in ([rng.integers(0, 999, 700), rng.integers(0, 3, 700), np.zeros(90, int)], [np.array([998])]):
        words = context_coder.encode_blocks(blocks, 999)
        back = context_coder.decode_blocks(words, np.array([len(b) for b in blocks]), 999)
        assert all((a == b).all() for a, b in zip(blocks, back))
    # repetition must pay
    text = np.tile(rng.integers(0, 50000, 40), 100)
    assert sum(map(len, context_coder.encode_blocks([text], 50000))) * 16 < 4 * len(text)


def test_damaged_block_is_noticed(tmp_path):
    w = context_coder.IdWriter(f"file://{tmp_path}", "a.bin", 100)
    w.add([1], np.arange(100, dtype=np.uint16), np.array([100]))
    path = w.close().column(0)[0].as_py()
    with open(path[7:], "r+b") as f:
        f.seek(30)
        byte = f.read(1)
        f.seek(30)
        f.write(bytes([byte[0] ^ 255]))
    import pyarrow as pa
    with pytest.raises(ValueError, match="damaged"):
        list(context_coder.read_ids([pa.RecordBatch.from_arrays([pa.array([path])], ["path"])], {path: 0}))


def test_language_id(docs, rows, empty, spark, sf):
    got = crf_langid.identify_languages(docs).collect()
    assert len(got) == len(rows) and crf_langid.identify_languages(empty).count() == 0
    for r in got:
        if r.doc_id in (0, 1, 2):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1)
    assert crf_langid.drop_unidentified(docs).columns == docs.columns
    table = spark.read.parquet(f"{sf}/documents.parquet")
    found = crf_langid.identify_languages(table).join(table.select("doc_id", "lang"), "doc_id") \
        .filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.9


def test_filter_without_labels(docs, rows):
    from pyspark.sql import functions as F
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    got = Counter(r.text for r in crf_langid.drop_unidentified(bare).collect())
    assert got == Counter(t for _, t, _ in rows if any(c.isalpha() for c in t or ""))
    assert {r.lang_pred for r in crf_langid.identify_languages(bare).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    from itertools import product
    rng = np.random.default_rng(4)
    lengths, move, begin = np.array([3, 1, 4]), rng.random((2, 2)) + 0.1, rng.random(2) + 0.1
    psi = rng.random((8, 2)) + 0.1
    packed = crf_langid.Packed(lengths)
    laid = np.empty_like(psi)
    laid[packed.at] = psi
    post = packed.posteriors(laid, move, begin)[0][packed.at]
    first = 0
    for n in lengths:
        mass = np.zeros((n, 2))
        for path in product(range(2), repeat=int(n)):
            p = begin[path[0]] * np.prod([psi[first + t, y] for t, y in enumerate(path)])
            p *= np.prod([move[a, b] for a, b in zip(path, path[1:])])
            for t, y in enumerate(path):
                mass[t, y] += p
        assert np.allclose(post[first:first + n], mass / mass.sum(axis=1, keepdims=True))
        first += n


ITEMS = [(1, SENTENCE), (2, "Word"), (3, None), (4, "!!"), (5, "lazy dog and runs far"), (5, "éa éa"), (10, SENTENCE)]


def words(t):
    import re
    return re.findall(rb"[0-9a-z\x80-\xff]+", lower(t))


def test_contamination(docs, rows, empty, spark):
    items = spark.createDataFrame([x + (0,) for x in ITEMS], "item_id long, text string, doc_id int")
    got = phrase_index.contamination(docs, items).collect()
    want = Counter()
    for i, t, _ in rows:
        ws, hit, found = words(t), set(), set()
        for item, phrase in ITEMS:
            ps = words(phrase)
            n = min(10, len(ps))
            for s in range(len(ps) - n + 1) if ps else ():
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == ps[s:s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want[i, len(ws), len(hit), len(found), digest, bool(hit)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert phrase_index.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in phrase_index.contamination(docs, items.limit(0)).collect())
    left = phrase_index.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == sum(n for k, n in want.items() if not k[5])
    near = phrase_index.proximity_matches(phrase_index.build_index(docs, items), 4).collect()
    assert all(abs(r.pos - r.pos2) <= 4 for r in near) and any(r.item_id == "1" for r in near)


def brute_fingerprint(t):
    w = lower(t).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ordered = list(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash(docs, rows, empty, spark, sf):
    assert simhash_vp.simhash_components(empty).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for frame, data in ((docs, [(i, t) for i, t, _ in rows]),
                        (table, [tuple(r) for r in table.select("doc_id", "text").collect()])):
        prints = [(i, brute_fingerprint(t)) for i, t in data]
        root = brute_components({p for _, p in prints})
        least = defaultdict(lambda: 1 << 60)
        for i, p in prints:
            if i is not None:
                least[root[p]] = min(least[root[p]], i)
        got = simhash_vp.simhash_components(frame).collect()
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == \
            Counter((i, p, least[root[p]] if root[p] in least else None) for i, p in prints)
    left = simhash_vp.one_per_component(docs)
    assert left.columns == docs.columns


def test_vantage_point_tree_finds_every_link():
    import pyarrow as pa
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    for _ in range(900):
        i, j = rng.integers(0, len(fps), 2)
        fps[j] = fps[i]
        for b in rng.integers(0, 64, 5):
            fps[j] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(fps)
    tree = simhash_vp.fit_tree(fps, len(fps), 200, 4)
    parts = defaultdict(list)
    for shard, at, here in simhash_vp.walk(fps, np.ones(len(fps), bool), tree, 4):
        parts[shard].append((at, here))
    assert len(parts) > 5
    edges = []
    for found in parts.values():
        t = pa.table({"fp": np.concatenate([fps[a] for a, _ in found]).view(np.int64),
                      "resident": np.concatenate([np.full(len(a), h) for a, h in found])})
        out = simhash_vp.link_shard(t, 4)
        edges += zip(out["a"].to_pylist(), out["b"].to_pylist())
    parent = np.arange(len(fps))
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    simhash_vp.union(parent, np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))
    mine = simhash_vp.roots(parent, np.arange(len(fps)))
    parent = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    simhash_vp.union(parent, i, j)
    assert (mine == simhash_vp.roots(parent, np.arange(len(fps)))).all()


def test_dense_ball_is_dealt_in_blocks():
    import pyarrow as pa
    import pyarrow.compute
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2 ** 64, 1000, dtype=np.uint64)
    ball = np.full(2000, fps[0])
    for _ in range(3):
        ball ^= np.uint64(1) << rng.integers(0, 64, len(ball)).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, ball]))
    tree = simhash_vp.fit_tree(fps, len(fps), 200, 4)
    dense = simhash_vp.dense_leaves(fps, len(fps), 200, tree, 4)
    batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])
    routed = pa.Table.from_batches(simhash_vp.route([batch], tree, 4, dense))
    own = Counter(s for s, r in zip(routed["shard"].to_pylist(), routed["resident"].to_pylist()) if r)
    assert max(own.values()) < 600  # without blocks the ball is one shard of some 2000
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    parent = np.arange(len(fps))
    for shard in set(routed["shard"].to_pylist()):
        out = simhash_vp.link_shard(routed.filter(pa.compute.equal(routed["shard"], shard)), 4)
        simhash_vp.union(parent, *(np.array([place[x] for x in out[c].to_pylist()], int) for c in "ab"))
    mine = simhash_vp.roots(parent, np.arange(len(fps)))
    parent = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    simhash_vp.union(parent, i, j)
    assert (mine == simhash_vp.roots(parent, np.arange(len(fps)))).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(simhash_vp.components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_kneser_ney(docs, rows, empty, spark):
    from math import isclose, log10
    from pyspark.sql import functions as F
    from typeahead.llm.common import id_remainder
    held = id_remainder(F.col("doc_id"), 7) == 2
    got = kneser_ney.perplexity_scores(docs, held).collect()
    assert kneser_ney.perplexity_scores(empty, held).count() == 0
    untrained = kneser_ney.perplexity_scores(docs, F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 for r in untrained)
    tokens = [lower(t).split() + [b" end"] for _, t, _ in rows]
    train = [w for (i, _, _), w in zip(rows, tokens) if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    uni, bi = Counter(w for d in train for w in d), Counter(p for d in train for p in zip([b" start"] + d, d))
    ctx, cont = defaultdict(Counter), Counter()
    for (u, v), c in bi.items():
        ctx[u][min(c, 3)] += 1
        ctx[u]["total"] += c
        cont[v] += 1

    def cuts(counts):
        of = Counter(counts)
        return (0, *kneser_ney.discounts(*(of[k] for k in (1, 2, 3, 4))))
    d, e, types = cuts(bi.values()), cuts(cont.values()), sum(cont.values())
    rest = sum(e[min(c, 3)] for c in cont.values()) / types / (len(uni) + 1)

    def p(u, v):
        low = max(0, cont[v] - e[min(cont[v], 3)]) / types + rest
        if u not in ctx:
            return low
        c = bi.get((u, v), 0)
        back = sum(d[k] * ctx[u][k] for k in (1, 2, 3)) / ctx[u]["total"]
        return (c - d[min(c, 3)]) / ctx[u]["total"] + back * low
    want = defaultdict(list)
    for (i, _, _), w in zip(rows, tokens):
        want[i].append((len(w), sum(uni[x] > 0 for x in w), sum(log10(p(u, v)) for u, v in zip([b" start"] + w, w))))
    for r in got:
        assert any((r.n_tokens, r.n_known) == x[:2] and isclose(r.score, x[2], rel_tol=1e-4) for x in want[r.doc_id])
        assert r.train_tokens == sum(uni.values())
    # probabilities after a context add up to one over the vocabulary and the unknown token
    for u in (b"the", b" start", b"never seen"):
        assert isclose(sum(p(u, v) for v in uni) + p(u, b"unknown"), 1.0, rel_tol=1e-9)


def test_kneser_ney_trigrams(docs, rows, empty, spark, monkeypatch):
    from math import isclose, log10
    from pyspark.sql import functions as F
    from typeahead.llm.common import id_remainder
    held = id_remainder(F.col("doc_id"), 7) == 2
    more = [(100 + i, " ".join(f"w{(i * j * j + i // 3) % 11}" for j in range(i % 40)), None) for i in range(150)]
    rows = rows + more
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in more], "doc_id long, text string"))
    assert kneser_ney.perplexity_scores(empty, held, order=3).count() == 0
    assert all(r.score == 0 for r in kneser_ney.perplexity_scores(docs, F.lit(True), order=3).collect())
    with pytest.raises(ValueError, match="order"):
        kneser_ney.perplexity_scores(docs, held, order=4)
    tokens = [lower(t).split() + [b" end"] for _, t, _ in rows]
    train = [w for (i, _, _), w in zip(rows, tokens) if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    uni = Counter(w for d in train for w in d)
    tri = Counter(t for d in train for t in zip([b" start"] + d, d, d[1:]))
    bi = Counter((v, w) for _, v, w in tri) + Counter((b" start", d[0]) for d in train)
    cont, ctx2, ctx3 = Counter(w for _, w in bi), defaultdict(Counter), defaultdict(Counter)
    for counts, ctx in ((bi, ctx2), (tri, ctx3)):
        for (*u, _), c in counts.items():
            ctx[tuple(u)][min(c, 3)] += 1
            ctx[tuple(u)]["total"] += c

    def cuts(counts):
        of = Counter(counts)
        return (0, *kneser_ney.discounts(*(of[k] for k in (1, 2, 3, 4))))
    d3, d2, d1, types = cuts(tri.values()), cuts(bi.values()), cuts(cont.values()), sum(cont.values())
    rest = sum(d1[min(c, 3)] for c in cont.values()) / types / (len(uni) + 1)

    def p(context, w):
        if not context:
            return max(0, cont[w] - d1[min(cont[w], 3)]) / types + rest
        counts, ctx, d = (bi, ctx2, d2) if len(context) == 1 else (tri, ctx3, d3)
        low = p(context[1:], w)
        if context not in ctx:
            return low
        c, of = counts.get((*context, w), 0), ctx[context]
        return (c - d[min(c, 3)] + sum(d[k] * of[k] for k in (1, 2, 3)) * low) / of["total"]
    for context in ((b"w1", b"w2"), (b" start", b"the"), (b"the", b"lazy"), (b"no", b"never"), (b"never", b"the")):
        assert isclose(sum(p(context, w) for w in uni) + p(context, b"unknown"), 1.0, rel_tol=1e-9)
    want = defaultdict(list)
    for (i, _, _), w in zip(rows, tokens):
        past = [b" start"] + w
        want[i].append((len(w), sum(log10(p(tuple(past[max(0, k - 1):k + 1]), x)) for k, x in enumerate(w))))
    for shard, heavy in ((kneser_ney.PAIR_SHARD, "one shard"), (400, "many shards")):
        monkeypatch.setattr(kneser_ney, "PAIR_SHARD", shard)
        got = kneser_ney.perplexity_scores(docs, held, order=3).collect()
        assert len(got) == len(rows)
        for r in got:
            assert any(r.n_tokens == n and isclose(r.score, x, rel_tol=1e-4) for n, x in want[r.doc_id]), heavy


def test_arc_to_warc(spark):
    long = "<p>" + "x" * 200 + "é</p>"
    pages = [(1, "http://a/ b", long), (2, "http://a", long), (3, None, "short"), (4, "http://b", "short"),
             (5, "http://c", None), (6, "http://d", "two\r\n\r\nparts\n" * 20), (7, "http://e", long), (7, "http://e", long)]
    frame = spark.createDataFrame([p + (9,) for p in pages], "page_id long, url string, html string, path int").repartition(3)
    got = arc_to_warc.read_warcs(arc_to_warc.arc_to_warc(arc_to_warc.write_arcs(frame))).collect()
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        first = min(j for j, _, h in pages if h == html)
        revisit = len(raw) >= 100 and first != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
             first if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    none = arc_to_warc.write_arcs(frame.limit(0))
    assert arc_to_warc.read_warcs(arc_to_warc.arc_to_warc(none)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_record_layouts(spark, tmp_path, version):
    import gzip
    payloads = {i: (f"<p>{i}</p>\n\nhttp://x 0.0.0.0 2000 text/html 5\n" + "y" * 3000 * i).encode() for i in range(40)}
    records = [arc_to_warc.version_block("a.arc.gz", version)]
    records += [arc_to_warc.arc_record(i, f"http://x/{i}", p, version, "a.arc.gz", 0) for i, p in payloads.items()]
    members = {"one.arc.gz": gzip.compress(b"".join(records)), "each.arc.gz": b"".join(map(gzip.compress, records)),
               "some.arc.gz": b"".join(gzip.compress(b"".join(records[i:i + 7])) for i in range(0, 41, 7)),
               "plain.arc": b"".join(records)}
    want = {(i, len(p), hashlib.sha256(p).hexdigest(), "response") for i, p in payloads.items()}
    for name, data in members.items():
        (tmp_path / name).write_bytes(data)
        got = arc_to_warc.read_warcs(arc_to_warc.arc_to_warc(
            spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string"))).collect()
        assert len(got) == 40 and {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got} == want
    for bad in (b"".join(records) + b"left over", b"".join(records)[:-9], b"".join(records) + b"left over\n"):
        for data in (bad, gzip.compress(bad)):
            (tmp_path / "bad.arc").write_bytes(data)
            with pytest.raises(ValueError, match="record header|declared length"):
                list(arc_to_warc.each_record(f"file://{tmp_path}/bad.arc"))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers(version):
    block = arc_to_warc.version_block("a.arc.gz", version)
    head, content, fields = arc_to_warc.parse_arc(block, None)
    assert len(fields) == (5 if version == 1 else 10) and content.startswith(str(version).encode())
    record = arc_to_warc.arc_record(3, "http://x/é y", b"a\n\nb", version, "a.arc.gz", 77)
    head, content, _ = arc_to_warc.parse_arc(record + b"trailing", fields)
    http, payload = arc_to_warc.http_parts(content)
    assert payload == b"a\n\nb" and arc_to_warc.page_id_of(http) == 3 and " " not in head["URL"]
    with pytest.raises(ValueError, match="declared length"):
        arc_to_warc.parse_arc(record[:-4], fields)
    assert arc_to_warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad-box ad">Buy now, it is cheap.</div>
<div role="search">find</div><article><header><h1>Title &amp; more</h1></header><p><b>First  para&nbsp;graph, long enough to be
read as text.<br>Same block.<p>Two.<!-- no --></p><ul><li>one item<li>two items</ul><blockquote>Quoted, at length, by someone.</blockquote>
<div class="comments"><p>I like this very much, thank you.</p></div></article><aside>Other, stories.</aside>
<form>name <input> <button>go</button></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert tag_paths.main_text(PAGE) == "\n\n".join([
        "Title & more", "First para graph, long enough to be read as text. Same block.", "Two.", "one item", "two items",
        "Quoted, at length, by someone."])
    for odd in (None, "", "<", "<p", "<p>", "<!-- open", "<script>x", "</p></div>"):
        assert tag_paths.main_text(odd) in ("", "<", "<p")
    assert tag_paths.main_text("plain text") == "plain text"
    assert len(tag_paths.main_text("<p>" + "word " * 100_000)) == 499_999
    links = "<div>" + "<p><a href=1>a</a></p>" * 30 + "<article>" + "<p>Long text, with marks, and more.</p>" * 5 + "</article></div>"
    assert tag_paths.main_text(links).count("Long") == 5 and "a\n" not in tag_paths.main_text(links)


LONG = "A sentence of the article stands here, and it goes on for a while. " * 9


def text_of(*blocks):
    return "\n\n".join(" ".join(b.split()) for b in blocks)


@pytest.mark.parametrize("n", [8, 12, 20, 200])
@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<section><div>{}</div></section>"])
def test_main_text_keeps_lists_and_tables(n, wrap):
    items = [f"short entry number {i}" for i in range(n)]
    lists = "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
    cells = "<table>" + "".join(f"<tr><td>{x}<td>{i}" for i, x in enumerate(items)) + "</table>"
    in_cells = [y for i, x in enumerate(items) for y in (x, str(i))]
    menu = "<div><ul>" + "<li><a href=x>Some page</a>" * 30 + "</ul></div>"
    for inner, short in ((lists, items), (cells, in_cells)):
        body = "<div>" + f"<p>{LONG}" * 5 + wrap.format(inner) + f"<p>{LONG}" * 5 + "</div>"
        got = tag_paths.main_text(menu + body)
        assert got == text_of(*[LONG] * 5, *short, *[LONG] * 5)
        # the same straight in the body
        got = tag_paths.main_text("<body>" + f"<p>{LONG}" * 5 + wrap.format(inner) + f"<p>{LONG}" * 5)
        assert got == text_of(*[LONG] * 5, *short, *[LONG] * 5)


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>"])
def test_main_text_huge_block(wrap):
    short = "x" * 97 + ", y"
    huge = ("word " * 26 + "end. ") * 150
    for around in ("<article>{}</article>", "<div>{}</div>", "{}"):
        got = tag_paths.main_text(around.format(f"<p>{short}" * 10 + wrap.format(f"<blockquote>{huge}</blockquote>")
                                                + f"<p>{short}" * 10))
        assert got == text_of(*[short] * 10, huge, *[short] * 10)


@pytest.mark.parametrize("wrapper", [
    "div class='content no-sidebar'", "div id=content class=has-banner", "section class='post comments-open'",
    "div class='with-sidebar'", "div class=sidebar", "div id=comments", "div class='left-sidebar main'", "form",
    "form id=aspnetForm class=form", "div role=form"])
@pytest.mark.parametrize("inner", ["{}", "<h1>Title</h1>{}", "<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_main_text_in_named_wrappers(wrapper, inner):
    tag = wrapper.split()[0]
    page = (f"<body><header><h1>Site</h1></header><div class=masthead>Our site</div><div class='site-footer'>Some imprint.</div>"
            f"<{wrapper}>" + inner.format(f"<p>{LONG}" * 4) + "<div class=share-buttons>Tell others, please.</div>"
            f"<div class=newsletter><form>Your address, please: <input></form></div></{tag}><div class='cookie-notice'>Crumbs, here.</div>")
    assert tag_paths.main_text(page) == text_of(*["Title"] * ("h1" in inner), *[LONG] * 4)


def test_main_text_reader_comments():
    for article in ("<article>{}</article>", "<div><h1>Title</h1>{}</div>"):
        page = article.format(f"<p>{LONG}") + "<div class=comments>" + f"<article><p>{LONG} I say.</article>" * 9 + "</div>"
        assert tag_paths.main_text(page) == text_of(*["Title"] * ("h1" in article), LONG)
    page = f"<article><p>{LONG}</article><div class=ad>" + f"<p>{LONG} Buy." * 9 + "</div>"
    assert tag_paths.main_text(page) == text_of(LONG)


def test_pages_frame(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in tag_paths.extract_main_text(frame).collect()}
    assert got[1].n_chars == len(got[1].text) and got[None].text == ""
    assert tag_paths.extract_main_text(frame.limit(0)).count() == 0


def test_kneser_ney_arrays_take_few_bytes():
    import numpy as np
    rng = np.random.default_rng(5)
    for bits, n in ((1, 3), (13, 5000), (21, 200_000), (32, 20_000)):
        ids = rng.integers(0, 1 << bits, (2, n), dtype=np.uint64)
        pairs = np.unique(ids[0] << np.uint64(32) | ids[1])
        hashed = kneser_ney.mix_ids(pairs, bits)
        order = np.argsort(hashed)
        data = kneser_ney.as_keys(hashed[order], 2 * bits)
        hit, at = kneser_ney.Keys(data, 2 * bits).find(hashed)
        assert len(set(hashed.tolist())) == len(pairs) and hit.tolist() == list(range(len(pairs)))
        assert (pairs[order][at] == pairs).all()
        other = np.setdiff1d(rng.integers(0, 1 << bits, 1000, dtype=np.uint64), hashed)
        assert not len(kneser_ney.Keys(data, 2 * bits).find(other)[0])
        low = kneser_ney.Planes(kneser_ney.as_planes(ids[1], bits), bits)
        assert (low[np.arange(n)] == ids[1]).all() and len(low) == n
        if bits == 21:
            assert len(data) < 5 * n and len(kneser_ney.as_planes(ids[1], bits)) == 3 * n
    n = rng.integers(1, 300, 10_000) ** 2
    counts = kneser_ney.as_counts(np.where(n < 60_000, 1 + n % 254, n))
    assert (kneser_ney.Counts(counts)[np.arange(10_000)] == np.where(n < 60_000, 1 + n % 254, n)).all()
    assert len(counts) < 10_000 * 5 and not len(kneser_ney.Keys(kneser_ney.as_keys(hashed[:0], 64), 64).find(hashed)[0])
