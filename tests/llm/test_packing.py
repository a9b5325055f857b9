import random
from collections import Counter, defaultdict

import brute
from support import listed

from weirline.llm.packing import pack, pack_documents


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, placed = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (capacity - used - size, n)
            for n, (used, s, c) in enumerate(bins)
            if used + size <= capacity and not (source and source in s) and not (cluster and cluster in c)
        ]
        if not fits:
            bins.append([0, set(), set()])
        n = min(fits)[1] if fits else len(bins) - 1
        placed.append((n, bins[n][0]))
        bins[n][0] += size
        bins[n][1].add(source)
        bins[n][2].add(cluster)
    return placed


def test_each_piece_goes_where_it_fits_best():
    draw = random.Random(2)
    for _ in range(200):
        n = draw.randint(1, 60)
        sizes = sorted((draw.randint(1, 20) for _ in range(n)), reverse=True)
        sources, clusters = ([draw.randint(0, 5) for _ in range(n)] for _ in range(2))
        assert pack(sizes, sources, clusters, 20) == plain_best_fit(sizes, sources, clusters, 20)


def check(rows, found, capacity, by_source):
    """All words are packed once, bins hold what they can and nothing that conflicts."""
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        if r.bin is not None:
            bins[r.bin].append(r)
    for doc, text, _ in rows:
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert sum(p.n_words for p in pieces) == len(brute.words(text))
        assert [p.start for p in pieces] == [capacity * k for k in range(len(pieces))]
    texts, sources = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_start)
        assert sum(r.n_words for r in held) <= capacity
        assert [r.bin_start for r in held] == [sum(h.n_words for h in held[:k]) for k in range(len(held))]
        assert max(Counter(texts[r.doc_id] for r in held).values()) == 1
        if by_source:
            assert max(Counter(sources[r.doc_id] for r in held if sources[r.doc_id]).values(), default=1) == 1
    return len(bins)


def test_given_table(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    for by_source in (False, True):
        n = check(rows, pack_documents(documents, 512, by_source, shard_rows=50).collect(), 512, by_source)
    total = sum(len(brute.words(t)) for _, t, _ in rows)
    assert n >= total / 512
    one_shard = check(rows, pack_documents(documents, 512).collect(), 512, False)
    assert one_shard <= 1.15 * max(total / 512, 1)


def test_odd_texts(odd, odd_rows, empty, repeated):
    found = pack_documents(odd, 100).collect()
    check([(i, t, None) for i, t in odd_rows], found, 100, False)
    assert {r.doc_id for r in found if r.bin is None} == {1, 2, 3}
    assert pack_documents(empty).count() == 0
    assert len(listed(pack_documents(repeated), "doc_id", "piece")) == repeated.count()


def test_equal_rows_spread_over_shards(spark):
    """One row over and over, its id null or not: no shard holds them all, and all are packed."""
    rows = [(None, "a b c", "s")] * 3000 + [(7, "d e", None)] * 3000 + [(8, "f", "s"), (9, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = pack_documents(docs, 16, shard_rows=100).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    shards = Counter(r.bin >> 32 for r in found if r.bin is not None)
    assert len(shards) == 61 and max(shards.values()) < 300
    held = defaultdict(list)
    for r in found:
        if r.bin is not None:
            held[r.bin].append(r)
    for inside in held.values():
        assert sum(r.n_words for r in inside) <= 16 and max(Counter(r.doc_id for r in inside).values()) == 1
