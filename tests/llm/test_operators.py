"""Each operator against brute force, a round trip or held-out labels, and on the awkward cases."""

import hashlib
import re
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesloom.llm import byte_cnn, fm_decontam, html_blocks, jaccard_join, license_scan, license_texts, pattern_packing, quality_rules, queries, sstable, suffix_dedup, winnowing
from seriesloom.llm._tokens import encoder

FOLDER = "/root/testdata/sf0.001"
PROSE = "Then the river of words went on past the mill and the old stone bridge, slow and brown, as it had for years. "
LONG = "".join(f"{PROSE}{i} " for i in range(900))
AWKWARD = [(1, None), (2, ""), (3, "   \n"), (4, LONG), (5, LONG), (6, "tie " * 400), (7, "tie " * 401), (8, PROSE * 2), (9, "é" * 150), (10, "a b"), (11, PROSE * 2)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows(texts):
    return sorted((r.doc_id, r.text or "") for r in texts.select("doc_id", "text").collect())


def frame(spark, data, **more):
    """Documents with columns whose names the operators use themselves, and some of more."""
    df = spark.createDataFrame(data, "doc_id long, text string")
    return df.withColumns({n: F.lit(i) for i, n in enumerate(("part", "kind", "sid", "a", "code"))})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# tokens


def test_chunked_ids_are_the_tokenizers_own(rows):
    from tokenizers import Tokenizer

    odd = ["don't CAN'T Élan! <|endoftext|> a<|startoftext|>b 1st x2y ΣΑΣ İstanbul", "A b\u0085d\x1ce\x0bf", "日本語 テキスト。", "ǅ ŉ ß ÿŸ ª", "́start \r\n\t x", "K ﬁ", "ẖ H̱ a.b.c 's't'RE", "\x00 \x01a", "a" * 5000, "🙂 👍🏽!!", "", "  ", "ab*** CD&&&"]
    whole = Tokenizer.from_file(queries.tokenizer_path())
    some = odd + [t for _, t in rows[:60]]
    assert encoder(queries.tokenizer_path()).encode(some) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(some, add_special_tokens=False)]


def ids_of(text):
    return np.frombuffer(encoder(queries.tokenizer_path()).encode([text or ""])[0], "<u4").tolist()


def test_shards_round_trip_and_look_up(spark, tmp_path):
    data = frame(spark, [*AWKWARD, (None, "no id"), (8, "again")])
    manifest = sstable.write_shards(data, queries.tokenizer_path(), 2, str(tmp_path))
    found = [tuple(r) for r in sstable.read_shards(spark, manifest).collect()]
    order = sorted([*AWKWARD, (None, "no id"), (8, "again")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, expected = 0, []
    for doc_id, text in order:
        ids = [*ids_of(text), 2]
        expected.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(found, key=lambda r: r[1]) == expected
    assert sorted(x.tolist() for x in sstable.lookup(manifest, 8)) == sorted([*ids_of(t), 2] for t in (PROSE * 2, "again"))
    assert sstable.lookup(manifest, 4)[0].tolist() == [*ids_of(LONG), 2] and sstable.lookup(manifest, 77) == [] and sstable.lookup(manifest, None)[0].tolist() == [*ids_of("no id"), 2]
    empty = sstable.write_shards(data.limit(0), queries.tokenizer_path(), 2, str(tmp_path / "none"))
    assert empty == [] and sstable.read_shards(spark, empty).count() == 0


def test_table_blocks(tmp_path):
    entries = [(i * 3, np.arange(i % 50, dtype="<u2").tobytes() * 40) for i in range(3000)]
    (tmp_path / "t").write_bytes(b"".join(sstable.encode_table(entries, 2)))
    table = sstable.Table(str(tmp_path / "t"))
    assert len(table.index) > 3 and table.docs == 3000
    assert [(i, x.tobytes()) for i, x in table] == entries
    assert all(table.get(i)[0].tobytes() == x for i, x in entries[::97])
    assert not any(table.get(i * 3 + 1) for i in range(0, 3000, 31)) and sum(table.may_have(i * 3 + 1) for i in range(3000)) < 90
    raw = bytearray((tmp_path / "t").read_bytes())
    raw[100] ^= 1
    (tmp_path / "bad").write_bytes(raw)
    with pytest.raises(ValueError):
        list(sstable.Table(str(tmp_path / "bad")))


def test_packing(spark):
    found = pattern_packing.pack(frame(spark, AWKWARD), queries.tokenizer_path(), 1, capacity=512).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in AWKWARD:
        ids = [*ids_of(text), 1]
        cut = [ids[i : i + 512] for i in range(0, len(ids), 512)]
        assert sorted(by_doc[doc_id]) == [(k, 512 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cut)]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert pattern_packing.pack(frame(spark, AWKWARD).limit(0), queries.tokenizer_path(), 1).count() == 0


def test_packing_plan_is_near_the_bound():
    draw = np.random.default_rng(3)
    counts = np.bincount(np.minimum(draw.lognormal(6, 1, 20000).astype(int) + 1, 4096), minlength=4097)
    runs = pattern_packing.plan(counts, 4096)
    placed = np.zeros(4097, int)
    for n, first, size, _, _ in runs:
        assert first == placed[n]
        placed[n] += size
    assert (placed == counts).all()
    assert max(s + k for _, _, k, s, _ in runs) <= 1.01 * (counts * np.arange(4097)).sum() / 4096 + 1


# fingerprints


def xx(seed, *parts):
    """Spark's xxhash64 of some values, the bytes of each seeded with the hash of those before."""
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def winnowed(text, k=4, window=4):
    """(hash, position) of the chosen k-grams, by a loop over all windows."""
    words = [w for w in re.split("[\x09-\x0D\x20]+", text) if w]
    if len(words) < k:
        return {(xx(42, " ".join(words).encode(), struct.pack("<i", len(words))), 0)} if words else set()
    grams = [xx(42, *(w.encode() for w in words[i : i + k])) for i in range(len(words) - k + 1)]
    upper = [(h & (1 << 64) - 1) >> 31 for h in grams]
    chosen = {max(range(s, min(s + window, len(grams))), key=lambda p: (-upper[p], p)) for s in range(max(1, len(grams) - window + 1))}
    return {(grams[p], p) for p in chosen}


def alike(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_winnowing(spark, texts, rows):
    found = {r.doc_id: r for r in winnowing.fingerprints(texts).collect()}
    backward = rows[::-1]
    for i, (doc_id, text) in enumerate(backward):
        after, third = backward[(i + 1) % len(backward)][1], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        one, two, three = winnowed(text), winnowed(edited), winnowed(after)
        assert set(zip(r.hashes, r.positions, strict=True)) == one and set(zip(r.edited_hashes, r.edited_positions, strict=True)) == two
        assert r.near_edited == pytest.approx(alike(one, two)) and r.near_next == pytest.approx(alike(one, three))
    by_text = defaultdict(set)
    for doc_id, text in rows:
        by_text[text].add(found[doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_winnowing_of_null_and_repeated_identifiers(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k"), (3, PROSE), (3, PROSE * 2), (3, PROSE), (1, "x")]
    found = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    after = {(i, t): order[(k + 1) % len(order)][1] for k, (i, t) in enumerate(order)}
    assert sorted((r.doc_id or 0, r.n_chars) for r in found) == sorted((i or 0, len(t)) for i, t in rows)
    edited = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in found) == edited and len(after) == 5


def test_winnowing_choice(spark):
    words = [f"w{i % 7}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    out = winnowing.with_fingerprint(df, "text", "fp", 3, 4).withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(57)), lambda i: F.xxhash64(*[F.get(F.split("text", " "), i + j) for j in range(3)]))).first()
    short = [(h & (1 << 64) - 1) >> 31 for h in out.h]
    chosen = sorted({max(range(i, i + 4), key=lambda p: (-short[p], p)) for i in range(len(short) - 3)})
    assert sorted(x.position for x in out.fp) == chosen and all(x.hash == out.h[x.position] for x in out.fp)


def test_winnowing_awkward(spark):
    found = {r.doc_id: r for r in winnowing.fingerprints(frame(spark, AWKWARD)).collect()}
    assert len(found) == len(AWKWARD) and found[1].n_chars == 0 and found[1].near_edited == 1.0
    assert found[4].fingerprint == found[5].fingerprint and found[8].fingerprint == found[11].fingerprint
    alone = winnowing.fingerprints(spark.createDataFrame([(1, PROSE)], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    assert winnowing.fingerprints(frame(spark, AWKWARD).limit(0)).count() == 0


# html


def test_html():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on the site for you.</div><article><h1>Title &amp; more</h1><p>It is a  very
    good day for the people of the town.<p>Yes.<script>var x="</p>";</script><aside>Related</aside><form><input>Sign up</form>
    <section class="comments"><p>I liked it very much, and so did the others of the house.</p></section></article><footer>&copy; me</footer></body>"""
    assert html_blocks.main_text(page) == "Title & more\nIt is a very good day for the people of the town.\nYes."
    plain = "<div id=menu><a href=x>Home</a> <a>About</a></div><div><p>The man was in the house and he was not at home on that day.</p><p>Ok.</p></div><div class=sidebar-left>x y z</div>"
    assert html_blocks.main_text(plain) == "The man was in the house and he was not at home on that day.\nOk."
    assert html_blocks.main_text(None) == "" == html_blocks.main_text("") == html_blocks.main_text("<script>x")
    assert html_blocks.main_text("<p>the words of a page<!-- open") == "the words of a page"


def test_html_names_inside_an_article():
    page = """<article><div class="article-header"><h1>Headline</h1></div><div class="byline">By the editor of the town</div><p class="tags">Yes.</p>
    <section id="discussion"><p>The discussion of the work was long, and it was good for all of them.</p></section><div id="related-work"><p>Work that is related to the work of the town.</p></div>
    <div class="post-comments"><p>I like the man who was in the house, and so did all of the others.</p></div><div class="ad-slot">Buy it now</div><ul class="share-buttons"><li>Mail it</li></ul></article>"""
    assert html_blocks.main_text(page).split("\n") == ["Headline", "By the editor of the town", "Yes.", "The discussion of the work was long, and it was good for all of them.", "Work that is related to the work of the town."]


PARAGRAPH = "The man was in the house and it was good for all of them."


@pytest.mark.parametrize("beside", [
    '<div class="article-footer">Filed under news of the town and the people in it.</div>', '<div class="widget">Weather today</div>', '<div class="site-header"><h2>Hdr</h2></div>', '<div class="header">Hdr of the page</div>', "<header><p>By the site</p></header>",
    '<div class="search-box">Look for it</div>', "<search>Find the words</search>", '<div class="alert">This is a notice to all of the readers of the town.</div>', '<div id="reader-remarks"><p>I like the man who was in the house, and so did all of the others.</p></div>',
    '<div class="top-banner">Buy the best of it now</div>', '<section class="entry-footer"><p>More of the same.</p></section>', '<div role="banner">Site of the town</div>', '<div class="sponsored-content">The best of all of the goods that are in the shop.</div>', "<footer>&copy; me</footer>",
])
def test_html_beside_the_text_of_an_article(beside):
    assert html_blocks.main_text(f"<article><h1>Title</h1><p>{PARAGRAPH}</p>{beside}<p>{PARAGRAPH}</p></article>") == f"Title\n{PARAGRAPH}\n{PARAGRAPH}"


@pytest.mark.parametrize("top", ['<div class="article-header"><h1>Title</h1><p>By me</p></div>', '<header class="entry-header"><h1>Title</h1><div><p>By me</p></div></header>', '<div class="banner"><h1>Title</h1>By me</div>', '<div class="page-header"><div><h1>Title</h1></div><p>By me</p></div>'])
def test_html_headers_with_the_headline_stay(top):
    assert html_blocks.main_text(f"<article>{top}<p>{PARAGRAPH}</p></article>") == f"Title\nBy me\n{PARAGRAPH}"


def test_html_malformed_tags():
    text = "The man was in the house and it was good for all of them."
    assert html_blocks.main_text(f'<article><p title="x>{text}</p></article>') == text
    assert html_blocks.main_text(f"<article><p title='a > b' data-x=\"<p>no</p>\">{text}</p></article>") == text
    assert html_blocks.main_text(f"<article><p title=it's>{text} 1 < 2 </ p> &am<b>p;</b></article>") == f"{text} 1 < 2 &amp;"
    assert html_blocks.main_text(f"<article><p>{text}</b></div></x></p") == text


@pytest.mark.parametrize("page", ['<a title="x ">' * 75_000 + "</a>", '<a x="' * 170_000, "<div>" * 120_000 + "</span>" * 60_000, "<b>" + "<div>" * 90_000 + "</b>" * 90_000, "</script " * 110_000, "<p>x</p>" * 125_000, "<p t='\">a</p>" * 77_001])
def test_html_takes_linear_time(page):
    began = time.process_time()
    html_blocks.main_text(page)
    assert time.process_time() - began < 15  # a quadratic scan of a megabyte takes hours


def test_html_very_long_page(spark):
    text = "The man was in the house and it was good for all of them."
    df = spark.createDataFrame([(1, "u", "<article>" + f"<p>{text}</p>" * 80_000 + "</article>")], "page_id long, url string, html string").withColumns({"text": F.lit("own"), "n_chars": F.lit(7)})
    r = html_blocks.extract(df).first()
    assert r.n_chars == 80_000 * (len(text) + 1) - 1 and r._text == "own" and r._n_chars == 7
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_html_pages(spark):
    data = [(1, "u", "<article><p>One of the best of all the pages that are there.</p></article>"), (2, "u", None), (2, "u", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(tuple(r) for r in html_blocks.extract(df).drop("_text").collect()) == [(1, "u", "One of the best of all the pages that are there.", 48), (2, "u", "", 0), (2, "u", "", 0)]


# repeats, copies, contamination


def removed(docs):
    seen, out = set(), {}
    for doc_id, text in docs:
        data = (text or "").encode()
        edge = np.zeros(len(data) + 1, int)
        for s in range(len(data) - 99):
            x = data[s : s + 100]
            if x in seen:
                edge[s] += 1
                edge[s + 100] -= 1
            seen.add(x)
        gone = np.cumsum(edge[:-1]) > 0
        raw = np.frombuffer(data, np.uint8)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest())
    return out


def test_repeats(texts, rows):
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.trim(texts.select("doc_id", "text")).collect()} == removed(rows)


def test_repeats_awkward(spark):
    found = suffix_dedup.trim(frame(spark, AWKWARD), with_text=True).collect()
    expected = removed(AWKWARD)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == expected
    assert {r.doc_id: r.text for r in found}[5] == "" and all(r.kind == 1 and r.part == 0 for r in found)
    twice = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.trim(twice).collect()) == [0, len(PROSE), len(PROSE)]
    assert suffix_dedup.trim(twice.limit(0)).count() == 0


def test_common_passage_with_different_sides(spark):
    draw = np.random.default_rng(1)
    side = lambda: "".join(draw.choice(list("abcdefgh "), 120))
    docs = [(i, side() + PROSE + side()) for i in range(60)] + [(100 + i, PROSE[: 20 + i] + side()) for i in range(80)]
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.trim(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == removed(docs)


def test_loser_tree_merges():
    draw = np.random.default_rng(2)
    runs = []
    for _ in range(5):
        items = sorted((bytes(draw.integers(0, 3, draw.integers(1, 12)).astype(np.uint8)), int(draw.integers(9)), 0, i) for i in range(40))
        runs.append(suffix_dedup.decoded(suffix_dedup.front_coded(items)))
    merged = list(suffix_dedup.LoserTree(runs))
    order = [x for _, x in merged]
    assert order == sorted(x for items, _ in runs for x in items)
    assert all(n == suffix_dedup.common_prefix(a[0], b[0]) for (_, a), (n, b) in zip(merged, merged[1:], strict=False))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(docs):
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_links(spark, texts, rows):
    assert {r.doc_id: tuple(r)[1:] for r in jaccard_join.link(texts).collect()} == linked(rows)


def test_links_of_a_large_group_of_near_copies(spark):
    draw = np.random.default_rng(4)
    base = [f"word{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = base.copy()
        for j in draw.choice(120, int(draw.integers(0, 9)), replace=False):
            w[j] = f"new{draw.integers(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    assert {r.doc_id: tuple(r)[1:] for r in jaccard_join.link(frame(spark, docs)).collect()} == linked(docs)


def test_links_of_groups_too_large_to_nest(spark, texts, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "NESTED_BLOCKS", 0)
    assert {r.doc_id: tuple(r)[1:] for r in jaccard_join.link(texts).collect()} == linked(rows)
    draw = np.random.default_rng(5)
    docs = []
    for i in range(80):
        w = [f"word{j}" for j in range(90)]
        for j in draw.choice(90, int(draw.integers(0, 8)), replace=False):
            w[j] = f"new{draw.integers(10**6)}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    assert {r.doc_id: tuple(r)[1:] for r in jaccard_join.link(frame(spark, docs)).collect()} == linked(docs)


def test_links_of_large_groups_that_ask(spark, texts, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "NESTED_BLOCKS", 0)
    monkeypatch.setattr(jaccard_join, "WORTH", 0)
    assert {r.doc_id: tuple(r)[1:] for r in jaccard_join.link(texts).collect()} == linked(rows)


def listed(key, comp):
    """Record batches of one block of lists, whose sets are components of one set each."""
    sid = np.array(comp, np.int64)
    block = jaccard_join.squeeze(jaccard_join.pack(np.array(key, np.uint64), sid, np.full(len(sid), 100), sid, np.ones(len(sid), np.int64)))
    return jaccard_join.batches(iter([(0, jaccard_join.LISTS, None, block, None)]), jaccard_join.ROW)


def test_a_long_list_asks_in_bounded_blocks():
    told = jaccard_join.open_questions(listed([7] * 2000, range(2000)), 1, 75)
    blocks = [jaccard_join.unpack(jaccard_join.expand(r[3]), *[np.int64] * 4) for r in told]
    assert max(len(b[0]) for b in blocks) < jaccard_join.MOST_TOLD + 2000
    assert sum(len(b[0]) for b in blocks) == 2000 * 1999 // 2
    assert len({pair for b in blocks for pair in zip(b[0].tolist(), b[1].tolist(), strict=True)}) == 2000 * 1999 // 2


def test_hubs_know_their_widest_list():
    told = jaccard_join.hub_links(listed([1, 1, 1, 2, 2, 3, 3], [4, 5, 9, 5, 9, 1, 4]), 1)
    found = {x for r in told for x in zip(*(b.tolist() for b in jaccard_join.unpack(jaccard_join.expand(r[3]), *[np.int64] * 4)), strict=True)}
    assert found == {(9, 9, 3, 0), (4, 4, 2, 0), (4, 9, 1, 1), (5, 9, 1, 1), (1, 4, 1, 1)}


def test_links_where_sets_share_a_name(spark, texts, rows):
    assert {r.doc_id: tuple(r)[1:] for r in jaccard_join.link(texts, id_bits=5).collect()} == linked(rows)


def test_links_of_null_and_repeated_identifiers(spark):
    df = frame(spark, [(3, LONG), (3, PROSE), (None, LONG), (2, LONG + "x"), (None, None)])
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join.link(df).collect()), key=str) == sorted([(3, 2), (3, 3), (None, 2), (2, 2), (None, None)], key=str)


def test_links_empty(spark):
    assert jaccard_join.link(frame(spark, AWKWARD).limit(0)).count() == 0


def judged(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = pattern.findall(lower(text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    out = {}
    for doc_id, text in docs:
        w, hit, names = pattern.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    names |= found
                    hit.update(range(k, k + n))
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_contamination(spark, texts, rows):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = fm_decontam.scan(texts.select("doc_id", "text"), benchmark).drop("text", "spans").collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == judged(rows, [tuple(r) for r in benchmark.collect()])


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_contamination_awkward(spark, block):
    items = [(1, PROSE), (2, "tie tie"), (3, None), (4, "!!!"), (5, PROSE), (6, "stone bridge, slow and brown")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = fm_decontam.scan(frame(spark, AWKWARD), benchmark, block_bytes=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == judged(AWKWARD, items)
    assert fm_decontam.scan(frame(spark, AWKWARD), benchmark.limit(0)).where("contaminated").count() == 0


def test_contamination_cut_and_own_names(spark):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, "old stone bridge")], "item_id long, text string")
    df = frame(spark, [(1, f"A b. {PROSE}Éc, d!"), (1, "A b."), (2, f"x {'y ' * 900}old stone bridge,  z"), (None, None)]).withColumns({"spans": F.lit("own"), "n_hit": F.lit(3)})
    found = fm_decontam.scan(df, items, cut=True).collect()
    assert sorted((r.doc_id or 0, r.text, r.contaminated, r._spans, r._n_hit) for r in found if r.text) == [(1, "A b.", False, "own", 3), (1, "A b. Éc, d!", True, "own", 3), (2, f"x {'y ' * 900}z", False, "own", 3)]
    assert fm_decontam.scan(df.limit(0), items).count() == 0


def test_repeats_keep_own_names(spark):
    df = frame(spark, [(1, PROSE * 2), (2, None)]).withColumns({"n_bytes": F.lit("own"), "n_spans": F.lit(5)})
    found = suffix_dedup.trim(df).collect()
    assert {r.doc_id: (r.n_removed, r._n_bytes, r._n_spans) for r in found} == {1: (len(PROSE), "own", 5), 2: (0, "own", 5)}


# licences and classifiers


def test_licences(spark):
    docs = [(1, f"{PROSE}\nReleased under the MIT License.\n{PROSE}"), (2, PROSE), (3, None), (4, "All rights reserved. " + PROSE + "all RIGHTS reserved!"), (5, PROSE + license_texts.TEXTS["MIT"].replace("merge", "blend")), (6, "rights all reserved")]
    found = {r.doc_id: [(m.template, m.first_word) for m in r.matches] for r in license_scan.scan(frame(spark, docs)).collect()}
    assert [x for x, _ in found[1]] == ["MIT-released"] and found[2] == found[3] == found[6] == []
    assert [x for x, _ in found[4]] == [] and [x for x, _ in found[5]] == ["MIT"]
    assert license_scan.scan(frame(spark, docs), {}).where(F.size("matches") > 0).count() == 0


def contained(words, template, slack):
    """The largest share of the template's shingles that stands in any place of its length, longer by a share of it."""
    k = min(5, len(template))
    own = {tuple(template[i : i + k]) for i in range(len(template) - k + 1)}
    n = len(template) + int(slack * len(template)) - k + 1
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return max((len(own & set(grams[s : s + n])) / len(own) for s in range(max(1, len(grams) - n + 1))), default=0)


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_licences_against_brute_force(spark, block):
    draw, known = np.random.default_rng(8), license_texts.NOTICES | license_texts.TEXTS
    words_of = lambda x: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    docs = []
    for name, text in known.items():
        for share in (0.0, 0.01, 0.02, 0.05, 0.1):
            w = text.split()
            for i in np.flatnonzero(draw.random(len(w)) < share):
                w[i] = f"other{i}"
            docs.append((len(docs), f"{PROSE} {' '.join(w)} {PROSE}"))
    table = spark.createDataFrame([*known.items(), ("empty", ""), ("none", None)], "name string, text string")
    found = {r.doc_id: {m.template for m in r.matches} for r in license_scan.scan(frame(spark, docs), table, block_bytes=block).collect()}
    wanted = got = 0
    for i, text in docs:
        words = words_of(text)
        sure = {n for n, t in known.items() if contained(words, words_of(t), 0) >= 0.75}
        may = {n for n, t in known.items() if contained(words, words_of(t), 0.4) >= 0.75}
        assert found[i] <= may
        wanted += len(sure)
        got += len(sure & found[i])
    assert wanted > 60 and got >= 0.99 * wanted  # the guarantee is 0.9999


def test_licences_of_repeated_rows_and_own_names(spark):
    df = frame(spark, [(1, license_texts.TEXTS["ISC"]), (1, license_texts.TEXTS["ISC"]), (None, LONG)]).withColumns({"matches": F.lit("own"), "n_words": F.lit(3)})
    found = license_scan.scan(df).collect()
    assert sorted(len(r.matches) for r in found) == [0, 1, 1] and all(r._matches == "own" and r._n_words == 3 for r in found)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_quality(spark, texts):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = quality_rules.score_documents(texts, labels).join(labels, "doc_id").collect()
    tested = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.predicted == r.quality for r in tested) >= 0.8 * len(tested)
    odd = quality_rules.score_documents(frame(spark, AWKWARD), labels.limit(0)).collect()
    assert len(odd) == len(AWKWARD) and {r.score for r in odd} == {0.5} and {r.predicted for r in odd} == {0}


def test_rules_fit_and_compile(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(2000, len(quality_rules.STATISTICS)))
    y = ((x[:, 3] > 0.2) & (x[:, 5] < 0.5)).astype(float)
    model = quality_rules.fit_rules(x, y)
    assert 0 < len(model.rules) <= 64
    scores = np.array([r[0] for r in spark.createDataFrame([(row,) for row in x.tolist()], "st array<double>").select(model.column("st")).collect()])
    assert ((scores > 0.5) == (y > 0.5)).mean() > 0.97


def test_lists_of_one_name_are_not_taken_for_each_other(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "mix", lambda x: np.zeros_like(x))  # all lists have one name
    key, sid = np.array([1, 1, 2, 2, 3, 3, 3, 4, 4], np.uint64), np.array([10, 11, 10, 11, 10, 11, 12, 10, 12])
    block = jaccard_join.squeeze(jaccard_join.pack(key, sid, sid, sid, np.ones(9, np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([0]), pa.array([block])], names=["part", "kind", "a", "b"])
    out = [jaccard_join.unpack(jaccard_join.expand(r[3]), np.uint64, *[np.int64] * 4)[1] for r in jaccard_join.distinct_lists(iter([batch]), 1)]
    assert np.concatenate(out).tolist() == [10, 11, 10, 11, 12, 10, 12]  # the second list repeats the first; the others are their own


def test_quality_of_awkward_tables(spark, texts):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    twice = texts.union(texts).withColumns({"st_log_chars": F.lit(1), "score": F.lit("own"), "__statistics": F.lit(2)})
    found = quality_rules.score_documents(twice, labels.union(labels)).collect()
    assert len(found) == 2 * texts.count() and len({(r.doc_id, r.score) for r in found}) == texts.count()
    kept = quality_rules.keep_good(twice, labels)
    assert kept.columns == twice.columns and 0 < kept.count() < len(found)
    assert quality_rules.score_documents(texts.limit(0), labels).count() == 0 == quality_rules.keep_good(texts.limit(0), labels).count()
    long = quality_rules.score_documents(frame(spark, [(1, LONG * 20), (1, LONG * 20), (None, None)]), labels).collect()
    assert len({r.score for r in long if r.doc_id}) == 1


def test_packing_of_null_and_repeated_identifiers(spark):
    found = pattern_packing.pack(frame(spark, [(None, PROSE), (None, PROSE), (1, PROSE), (1, "x"), (2, None)]), queries.tokenizer_path(), 1, capacity=64).collect()
    assert sorted((r.doc_id or 0, r.length) for r in found) == sorted([(0, len(ids_of(PROSE)) + 1)] * 2 + [(1, len(ids_of(PROSE)) + 1), (1, len(ids_of("x")) + 1), (2, 1)])


def test_quality_without_identifiers(spark, texts):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    some = texts.select(F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")).alias("doc_id"), "text")
    found = quality_rules.score_documents(some, labels).collect()
    assert len(found) == texts.count() and sum(r.doc_id is None for r in found) == texts.where("doc_id % 5 = 0").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)


def test_languages_of_repeated_and_no_rows(spark, texts):
    rows = texts.select(F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 20).alias("doc_id"), "text", "lang")
    found = byte_cnn.identify(rows, most_windows=300).collect()
    assert len(found) == texts.count() and {r.lang_pred for r in found} <= {"en", "de", "fr", "es", "und"}
    assert byte_cnn.identify(rows.limit(0), most_windows=300).count() == 0


def test_rare_languages_are_drawn(spark):
    rows = [(i, "en" if i % 50 else "xx", PROSE if i % 50 else "zqk zqk wvx " * 30) for i in range(1000)]
    held, names = byte_cnn.sample(spark.createDataFrame(rows, "id long, lang string, text string"), 200)
    assert len(held) == len(names) <= 200 and 60 < names.count("xx") <= 80 and names.count("en") > 60
    df = spark.createDataFrame([(1, "abc", "own", 2)], "doc_id long, text string, lang_pred string, score int")
    assert byte_cnn.predict(df, None).first().asDict() == {"doc_id": 1, "text": "abc", "_lang_pred": "own", "_score": 2, "lang_pred": "und", "score": 0.0}


def test_languages(spark, texts):
    found = byte_cnn.identify(texts, most_windows=3000).join(texts.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.9 * len(found)
    odd = frame(spark, [*AWKWARD, (12, "123 !!")]).withColumn("lang", F.when(F.col("doc_id") < 6, "en").otherwise("xx"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in byte_cnn.identify(odd, most_windows=200).collect()}
    assert {got[i] for i in (1, 2, 3, 12)} == {("und", 0.0)} and got[4] == got[5] and 0 < got[4][1] <= 1
    assert {r.lang_pred for r in byte_cnn.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# all queries and the pipeline


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        assert out.columns == texts.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) >= 0.6 * len(before), name
        if name == "n-gram Jaccard join":
            assert set(after) == {r for r, (_, c) in linked(sorted(before.items())).items() if r == c}
        if name == "benchmark decontamination":
            expected = judged(sorted(before.items()), [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
            assert set(after) == {i for i, x in expected.items() if not x[4]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.collect()} == set(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))
