"""The text-corpus operators against brute force, and on odd rows and tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("streetloom.llm")
from streetloom.llm import ann, cotraining, html_wrappers, mixing, near_join, packing, privacy, pseudo_likelihood, quality_rules, registry, runtime, shingles, textbuf, token_store, tokenize  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, _row long"
WORD = r"[^\x20\x09-\x0d]+"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, 7, None) for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice("the of and to a in is that it for was on red blue house river stone walks quickly under over again morning".split()) + rng.choice(["", "", "", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        (0, base, "en", "a", 10), (1, base, "en", "a", 10), (2, near, "en", "b", None), (3, None, "en", "b", 0), (4, "", None, None, 0), (5, "  \t\n ", "xx", "b", 3), (6, "One two", "de", "", 7), (7, "one TWO", "de", "c", 7),
        (8, prose(rng, 30_000), "fr", "a", 1), (9, "x" * 200_000, "en", "a", 1), (None, base, "en", None, 5), (10, "mail a.b@c.de or +1 (555) 123-4567, 10.0.0.256; 4111 1111 1111 1111", "es", "c", 9), (10, "repeated id", "en", "c", 11),
        (11, base, "en", "a", 10), (11, base, "en", "a", 10), (12, "é́ <|endoftext|> ﬁ ǅ İstanbul 🙂🙂 日本 a b c\x1dd\r\n\r\nend  ", "ja", "é", 30), (13, prose(rng, 700), "en", "𝒳", 3),
    ]


@pytest.fixture(scope="module")
def tables(spark, odd):
    return frame(spark, odd).repartition(3).cache(), frame(spark, [])


def texts_of(odd):
    return [(r[0], r[1] or "") for r in odd]


# ---- tokenizers, op 1 and op 6 -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_unit_tokenizer_equals_the_library(name):
    import pyarrow as pa

    rng = random.Random(2)
    letters = [" ", " ", "  ", "\n", "\n\n", "\t", "a", "Bc", "É", "1", "23", ".", ",", "'s", "'", "é", "中", "!", "́", "\r", "ﬁ", "<|endoftext|>", " ", "🙂", "-", "İ", "ß"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    own = tokenize.UnitTokenizer(registry.vocabulary(name))
    texts += ["<|endoftext|>", "a  ", "b", " <|endof", "text|> ", "", "<|endoftext|>" * 3, "<|startoftext|> x<|endoftext|>"]
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    for first, end, buf, offsets in textbuf.chunks(pa.array(texts), 3000):
        ids, at = own.encode(buf, offsets)
        for row in range(first, end):
            assert ids[at[row - first] : at[row - first + 1]].tolist() == want[row], repr(texts[row])


def library(name):
    """The tokenizers library with its defaults, on its own."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary(name))


def library_ids(name, text):
    return library(name).encode(text, add_special_tokens=False).ids


def test_dac_random_access_and_round_trip():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 50_000, 3000), np.zeros(5, int), (rng.pareto(0.6, 4000) * 3).astype(int) % 60_000, np.array([1 << 20])):
        shard = token_store.Shard(token_store.encode_shard(values, [1, None], np.array([0, 1, len(values)]), part=0, shard=0, start=0) + b"\n")
        assert shard.ids().tolist() == values.tolist()
        assert [shard.at(int(i)) for i in range(0, len(values), 7)] == values[::7].tolist()
    with pytest.raises(ValueError):
        token_store.Shard(b"DAC1" + b"\0" * 40)


def test_token_store(spark, tables, odd):
    path = runtime.shared_folder(spark)
    token_store.write(tables[0], path, registry.vocabulary("byte_bpe_50k.json"), 2, shard_tokens=500)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    want, start = [], 0
    for doc, text in sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*library_ids("byte_bpe_50k.json", text), 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    first = got[3]
    place = spark.createDataFrame([(first.part, first.shard, first.local_start)], "part int, shard int, position long")
    text = sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[3][1]
    assert token_store.read_tokens(spark, path, place).first().token == library_ids("byte_bpe_50k.json", text)[0]
    token_store.write(tables[1], path + "-none", registry.vocabulary("byte_bpe_50k.json"), 2)
    assert token_store.read_documents(spark, path + "-none").count() == 0


def test_room_tree_finds_the_tightest_window():
    rng = random.Random(1)
    tree, rooms = packing.RoomTree(64), []
    for i in range(3000):
        if rng.random() < 0.6:
            room = rng.randint(1, 64)
            tree.put(room, i)
            rooms.append(room)
        else:
            need = rng.randint(1, 64)
            found = tree.tightest(need)
            best = min((r for r in rooms if r >= need), default=None)
            assert (found and found[1]) == best
            if best:
                rooms.remove(best)


def test_packing(spark, tables, odd):
    rows = packing.pack(tables[0], registry.vocabulary("word_bpe_49k.json"), 1, window=256).collect()
    sequences, documents = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        total = sum(r.length for r in own)
        assert 0 < total <= 256
        padding += 0 if total & (total - 1) == 0 else 256 - total
    assert padding <= 0.01 * sum(r.length for r in rows)
    want = Counter()
    for doc, text in texts_of(odd):
        want[doc, tuple([*library_ids("word_bpe_49k.json", text), 1])] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
    for (doc, ids), n in want.items():
        own = sorted(pieces[doc, len(ids)], key=lambda r: r.start)
        assert sum(r.length for r in own) == n * len(ids)
        for r in own:
            assert np.frombuffer(r.ids, "<u4").tolist() == list(ids[r.start : r.start + r.length])
    assert packing.pack(tables[1], registry.vocabulary("word_bpe_49k.json"), 1).count() == 0


# ---- op 2 ----------------------------------------------------------------------------------------


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_of(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m[0]))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)


def test_base_spans_on_random_texts(spark):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@x.de", ".", "-", "_d", "%", " ", "1", "12", "4111 1111 1111 1111", "255.255.0.01", "1.2.3.4.5", "300.1.1.1", "+49 (30) 123-456", "+1", "++12345678901", "é", "🙂", "\n", "4012888888881881", "0-", "a@b.c_d@e.ff", "9 9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(2500)] + ["9" * 50_000, "a" * 50_000 + "@", "a@" + "b." * 20_000 + "c", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4).select("i", privacy.spelled(privacy.base_spans(F.col("text"))).alias("s")).collect()
    for r in rows:
        assert r.s == base_of(texts[r.i]), texts[r.i][:100]


def test_texts_with_very_many_spans(spark):
    import time

    pieces = ["a.b@c.de", "10.0.0.1", "+49 30 123456 7", "word é🙂", "\n"]
    rng = random.Random(7)
    text = " ; ".join(rng.choice(pieces) for _ in range(30_000))
    began = time.time()
    row = spark.createDataFrame([(text,)], "text string").select(privacy.base_spans(F.col("text")).alias("s"), "text").select(privacy.spelled(F.col("s")).alias("spans"), privacy.sanitised(F.col("text"), F.col("s"), F.array().cast("array<string>")).alias("clean")).first()
    assert row.spans == base_of(text)
    assert row.clean == text.replace("a.b@c.de", "[EMAIL]").replace("10.0.0.1", "[IP]").replace("+49 30 123456 7", "[PHONE]")
    assert time.time() - began < 30


def test_privacy_of_odd_tables(spark, tables, odd):
    rows = privacy.find(tables[0], keep=True)
    assert rows.count() == len(odd)
    got = Counter((r.doc_id, r.s) for r in rows.select("doc.doc_id", privacy.spelled(F.col("base")).alias("s")).collect())
    assert got == Counter((doc, base_of(text)) for doc, text in texts_of(odd))
    clean = privacy.sanitise(tables[0])
    assert clean.columns == tables[0].columns
    texts = Counter(r.text for r in clean.collect())
    assert "mail [EMAIL] or [PHONE], 10.0.0.256; [CARD]" in texts
    assert sum(texts.values()) == len(odd)
    assert privacy.find(tables[1]).count() == privacy.sanitise(tables[1]).count() == 0


def test_terms_that_reveal_are_found_and_others_left(spark):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng, 40)} zanzibarite number {i} boss@secret.org {prose(rng, 20)}" if i < 12 else prose(rng, 60), "en", "a", 1) for i in range(400)]
    rows += [(400 + i, f"{prose(rng, 30)} shared@corp.org", "en", "a", 1) for i in range(6)]
    found = privacy.find(frame(spark, rows), keep=True).select("doc.doc_id", "doc.text", F.expr("transform(filter(spans, s -> s.kind = 4), s -> s.value)").alias("terms")).collect()
    for r in found:
        assert set(r.terms) == ({"zanzibarite", "number"} if r.doc_id < 12 else set()), r
    text = privacy.sanitise(frame(spark, rows)).where("doc_id = 3").first().text
    assert "zanzibarite" not in text and "boss@" not in text and "[EMAIL]" in text


def test_terms_of_rare_entities_and_beside_copies(spark):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 30)} no {rng.random()}", "en", "a", 1) for i in range(3300)]
    rows[7] = (7, f"{prose(rng, 30)} quxolite solo@one.org", "en", "a", 1)
    terms = F.expr("transform(filter(spans, s -> s.kind = 4), s -> s.value)").alias("terms")
    found = {r.doc_id: r.terms for r in privacy.find(frame(spark, rows), keep=True).select("doc.doc_id", terms).collect()}
    assert found.pop(7) == ["quxolite"] and not any(found.values())
    # ten texts share a term and an entity; many copies of one of them are no further evidence
    rows = [(i, f"{prose(rng, 40)} no {rng.random()}", "en", "a", 1) for i in range(400)]
    pairs = [(400 + i, f"{prose(rng, 20)} zanzibarite boss@secret.org {i}", "en", "a", 1) for i in range(10)]
    copies = [(500 + i, *pairs[0][1:]) for i in range(190)]
    found = {r.doc_id: r.terms for r in privacy.find(frame(spark, rows + pairs + copies), keep=True).select("doc.doc_id", terms).collect()}
    assert all(set(v) == ({"zanzibarite"} if doc >= 400 else set()) for doc, v in found.items())


# ---- op 3 ----------------------------------------------------------------------------------------


def shingle_set(text, k):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = [(doc, shingle_set(text, k)) for doc, text in rows if doc is not None]
    parent = {doc: doc for doc, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and den * both >= num * (len(s) + len(t) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {doc: top(doc) for doc in parent}, [(doc, len(s)) for doc, s in sets]


def test_join_of_odd_tables(spark, tables, odd):
    got = near_join.near_components(tables[0], 4, 85, 100).collect()
    want, sizes = brute_components(texts_of(odd), 4, 85, 100)
    assert len(got) == len(odd)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert Counter((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == Counter(sizes)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = [r.doc_id for r in near_join.one_of_each(tables[0], 4, 85, 100).collect()]
    assert sorted(kept, key=lambda x: -1 if x is None else x) == [None, *sorted(d for d, c in want.items() if d == c)]
    assert near_join.near_components(tables[1]).count() == near_join.one_of_each(tables[1]).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_join_loses_no_link_in_large_groups(spark, seed, monkeypatch):
    """Chains of edits, groups larger than a bucket's pair list and than a block, passages shared by many."""
    monkeypatch.setattr(near_join, "BLOCK_BYTES", 4000)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        current = base[:]
        for _ in range(70):
            copy = base[:] if rng.random() < 0.5 else current[:]
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            current = copy
            rows.append((len(rows), " ".join(copy)))
    for _ in range(60):
        rows.append((len(rows), " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 25))])))
    for _ in range(40):
        rows.append((len(rows), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))))
    frame_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, num in ((4, 85), (5, 80)):
        want, _ = brute_components(rows, k, num, 100)
        got = {r.doc_id: r.component_id for r in near_join.near_components(frame_, k, num, 100).collect()}
        assert got == want


@pytest.mark.parametrize("one_task", [0, 40, 10**6])
def test_components_of_random_links(spark, monkeypatch, one_task):
    from streetloom.llm import components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(one_task)
    links = [(rng.randrange(300) * 7 - 50, rng.randrange(300) * 7 - 50) for _ in range(180)] + [(5000 + i, 5001 + i) for i in range(40)]
    parent = {x: x for pair in links for x in pair}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    found = components.components(spark.createDataFrame(links, "a long, b long"), runtime.Tables(spark)).collect()
    assert sorted((r.node, r.component) for r in found) == sorted((x, top(x)) for x in parent)
    assert components.components(spark.createDataFrame([], "a long, b long"), runtime.Tables(spark)).count() == 0


def test_pages_with_very_many_blocks_and_levels():
    import time

    parse, wrap = html_wrappers.parse, html_wrappers._wrap
    began = time.time()
    pages = ["<html><body><main>" + "".join(f"<h2>t{k}</h2>" if rng.random() < 0.5 else f"<p class=c{k % 90}>text {k}</p>" for k in range(10_000)) + "</main></body></html>" for rng in (random.Random(s) for s in range(3))]
    wrapper = wrap(parse(pages[0]))
    for page in pages[1:]:
        wrapper = html_wrappers.merge(wrapper, wrap(parse(page)))
    assert len(html_wrappers.extract(pages[0], html_wrappers.plan(wrapper)).split("\n\n")) == 10_000
    assert time.time() - began < 20
    deep = "<article>" + "<div>" * 300 + "<p>inside</p><nav><p>menu</p></nav><p>more</p>" + "</div>" * 300 + "<p>after</p></article><footer>foot</footer>"
    assert html_wrappers.extract(deep) == "inside\n\nmore\n\nafter"


def test_long_constant_notices_are_furniture_and_articles_stay():
    notice = "This notice is the same on every page of the host. " * 8
    page = lambda k: f"<body><main><p>{notice}</p><h1>Title {k}</h1><p>{' '.join(f'word{k}x{i}' for i in range(80))}</p><p>End {k}.</p></main></body>"
    wrapper = html_wrappers._wrap(html_wrappers.parse(page(0)))
    for k in range(1, 12):
        wrapper = html_wrappers.merge(wrapper, html_wrappers._wrap(html_wrappers.parse(page(k))))
    found = html_wrappers.extract(page(3), html_wrappers.plan(wrapper))
    assert "This notice" not in found and found.startswith("Title 3\n\nword3x0") and found.endswith("End 3.")


def test_hosts_of_urls(spark):
    urls = {"http://A.b/c": "a.b", "//h/x": "h", "https://u:p@Host.de:80/": "host.de", "http://[::1]:80/x": "[::1]", "nothing": "", None: "", "": "", "mailto:x@y": ""}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", html_wrappers.host(F.col("url")).alias("host")).collect()
    assert {r.url: r.host for r in rows} == urls


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    table = shingles.bands(85, 100)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        drop, add = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(1, 2**63, add, dtype=np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(shingles.bit_sketch(s), "<u8") for s in (a, b))
        words = min(len(x), len(y))
        assert np.bitwise_count(shingles.folded(x, words) ^ shingles.folded(y, words)).sum() <= len(a) + len(b) - 2 * both
        if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            (keys_a, least_a), (keys_b, least_b) = shingles.lane_keys(a, table), shingles.lane_keys(b, table)
            shared = Counter((np.intersect1d(keys_a, keys_b) % np.uint64(64)).tolist())
            first = least_a[0] if len(a) < len(b) else least_b[0]  # they meet in the band of the smaller
            for least in {*least_a, *least_b}:
                if least % 64 == first % 64:
                    assert shared[least % 64] >= least // 64 > 0


# ---- op 4 ----------------------------------------------------------------------------------------


def brute_mix(rows):
    sizes = [(doc, source, len(re.findall(WORD, text))) for doc, source, text in rows]
    names = sorted({s for _, s, _ in sizes if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for _, s, _ in sizes) else [])
    own = {s: sum(z for _, t, z in sizes if t == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(own.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * own[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * own[s]
            left -= target[s]
        open_ -= full
    return sizes, own, target


def test_mix(spark, tables, odd):
    sizes, own, target = brute_mix([(r[0], r[3], r[1] or "") for r in odd])
    rows = mixing.mix(tables[0]).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, z) for d, _, z in sizes)
    by = {(d, z): s for d, s, z in sizes}
    for r in rows:
        s = by[r.doc_id, r.size]
        assert r.source_size == own[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
    again = mixing.mix(tables[0].repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    empty = mixing.mix(tables[1])
    assert empty.count() == 0 and mixing.apply_mix(tables[1], empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 80)), "en", rng.choice("aaaaaabcde"), 1) for i in range(3000)]
    docs = frame(spark, rows)
    plan = mixing.mix(docs).cache()
    source = {r[0]: r[3] for r in rows}
    taken, target = Counter(), {}
    for r in plan.collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 160
    mixed = mixing.apply_mix(docs, plan)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in plan.collect() if r.copies})


# ---- op 5 ----------------------------------------------------------------------------------------


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a><li><a href='/x'>X</a></ul></nav>{body}{extra}<footer>&copy; me</footer><script>var p='</p>';</script></body></html>"


def test_main_text():
    rng = random.Random(3)
    pages, want = [], []
    for i in range(12):
        a, b = prose(rng, 50), prose(rng, 60)
        aside = "<aside class='sidebar'><p>Popular now and then</p></aside>" * (i % 2)
        body = f"<div id='wrap'><div class='cookie-notice'>We use cookies</div><div class='post'><h2>Title {i} &amp; more</h2><p>{a}<p><b>{b}<br>tail</b></p><div class='share'>Share it</div></div>{aside}<div class='comments'><p>Nice {i}</p></div></div>"
        pages.append(page(body))
        want.append("\n\n".join([f"Title {i} & more", a, f"{b} tail"]))
    whole = None
    for html in pages:
        w = html_wrappers._wrap(html_wrappers.parse(html))
        whole = w if whole is None else html_wrappers.merge(whole, w)
    plan = html_wrappers.plan(whole)
    assert "?" in html_wrappers.expression(whole) and "+" in html_wrappers.expression(whole) and "#" in html_wrappers.expression(whole)
    assert [html_wrappers.extract(h, plan) for h in pages] == want
    assert html_wrappers.extract(pages[0]) == want[0]


def test_pages_of_odd_tables(spark):
    article = "<article><h1>Title</h1><p>One &lt; two\n\n three</p><form>no</form></article>"
    rows = [(1, "http://a.example/1", page(article)), (1, "http://a.example/1", page(article)), (2, None, page(article)), (3, "http://[bad", ""), (4, "x", None), (None, "HTTP://A.example/2", "<p>plain"), (5, "y", "<!-- never closed <p>a"), (6, "z", "<div>" * 5000 + "deep" + "</div>" * 10), (7, "q", "<p a='unclosed>text</p> <b>tail")]
    frame_ = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, plan string")
    got = html_wrappers.main_text(frame_).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in (1, 2):
            assert r.text == "Title\n\nOne < two three"
        if r.page_id in (3, 4):
            assert r.text == ""
        if r.page_id == 6:
            assert r.text == "deep"
    assert html_wrappers.main_text(frame_.limit(0)).count() == 0


# ---- op 7 and op 9 -------------------------------------------------------------------------------


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(60, 200)) if good else " ".join(rng.choice(["BUY", "###", "$$$", "NOW!!", "win***"]) for _ in range(rng.randint(60, 200)))
        rows.append((i, text, "en", ("good" if good else "junk") if rng.random() < 0.8 else "mixed", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_cotraining_on_held_out_rows(spark, tables):
    rows, labels = labelled(random.Random(1), 400)
    docs = frame(spark, rows).cache()
    model = cotraining.train(docs, spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int"))
    truth = {i: q for i, q, _ in labels[200:]}
    got = {r.doc_id: r for r in cotraining.score(docs, model).collect()}
    assert np.mean([got[i].kept == bool(q) for i, q in truth.items()]) > 0.95
    assert cotraining.score(tables[0], model).count() == tables[0].count()
    assert cotraining.score(tables[1], model).count() == 0
    none = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    assert cotraining.train(tables[0], none) is None
    assert {r.score for r in cotraining.score(tables[0], None).collect()} == {0.5}


def test_corpus_wide_limits_against_sorting():
    rng = np.random.default_rng(8)
    for n, share, positive, floor in ((5000, 0.1, 0.7, 0.0), (300, 0.05, 0.5, 1.0), (40, 0.15, 0.9, 2.5), (3, 0.05, 0.5, 0.0), (1000, 0.1, 0.3, np.inf)):
        logits = rng.normal(0, 2, n)
        low, high = cotraining.limits(np.bincount(cotraining._bins(logits), minlength=cotraining.BINS), share, positive, floor)
        at, ranked = cotraining._bins(logits), np.sort(logits)
        bad, good = logits[at <= low], logits[at >= high]
        # no more than the share, all beyond the floor, and the most extreme ones
        assert len(bad) <= share * (1 - positive) * n + 1e-9 and len(good) <= share * positive * n + 1e-9
        assert sorted(bad) == ranked[: len(bad)].tolist() and sorted(good) == ranked[n - len(good) :].tolist()
        width = 2 * cotraining.RANGE / cotraining.BINS
        assert (bad <= -floor + width).all() and (good >= floor - width).all()


def test_every_unlabelled_document_takes_part(spark):
    """The histograms of each round count all of them, and a fit on all parts equals one on the rows together."""
    import pyarrow as pa

    rows, _ = labelled(random.Random(3), 300)
    features = frame(spark, rows).select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(cotraining._gather, cotraining._FIELDS).collect()
    views = [cotraining.View(cotraining.BUCKETS + cotraining.DENSE), cotraining.View(cotraining._META)]
    rng = np.random.default_rng(2)
    for view in views:
        view.weights, view.bias = rng.normal(size=len(view.weights)), 0.3
    batch = lambda own: pa.RecordBatch.from_arrays([pa.array([bytes(r[c]) for r in own], pa.binary()) for c in ("at", "value", "dense", "meta")], ["at", "value", "dense", "meta"])
    parts = [b for own in (features[:100], features[100:]) for b in cotraining._histogram(views)(iter([batch(own)]))]
    (whole,) = cotraining._histogram(views)(iter([batch(features)]))
    summed = {r["view"]: np.frombuffer(r["counts"], np.int64) for b in cotraining._add_histograms(iter(parts)) for r in b.to_pylist()}
    for r in whole.to_pylist():
        assert summed[r["view"]].tolist() == np.frombuffer(r["counts"], np.int64).tolist() and summed[r["view"]].sum() == len(rows)
    sparse = cotraining.sparse(*([bytes(r[c]) for r in features] for c in ("at", "value", "dense", "meta")))
    for k, (view, (at, value, row)) in enumerate(zip(views, sparse, strict=True)):
        plain = [sum(view.weights[a] * v for a, v in zip(at[row == i], value[row == i], strict=True)) + view.bias for i in range(20)]
        assert view.logits((at, value, row), len(features))[:20] == pytest.approx(plain), k


def test_pseudo_likelihood(spark, tables):
    rng = random.Random(2)
    order = [(i, " ".join("alpha beta gamma delta".split() * 30), "en", "a", 1) for i in range(80)]
    mess = [(1000 + i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(120)), "en", "a", 1) for i in range(5)]
    got = {r.doc_id: r for r in pseudo_likelihood.score(frame(spark, order + mess).repartition(2)).collect()}
    assert min(got[i].mean_log for i in range(80)) > max(got[1000 + i].mean_log for i in range(5))
    odd_rows = pseudo_likelihood.score(tables[0]).collect()
    assert len(odd_rows) == tables[0].count()
    for r in odd_rows:
        assert (r.mean_log is None) == (r.n_words == 0) and np.isfinite(r.log_likelihood)
    assert pseudo_likelihood.score(tables[1]).count() == 0


def test_network_learns():
    rng = np.random.default_rng(1)
    words = pseudo_likelihood.Vocabulary(np.arange(1, 200, dtype=np.uint64), np.arange(200, 1, -1), np.full(pseudo_likelihood.BUCKETS, 3))
    weights = pseudo_likelihood.fresh_weights(words)
    windows = rng.integers(0, words.edge, (3, 2 * pseudo_likelihood.SIDE))
    trainer, groups, slots = pseudo_likelihood.Trainer(weights), np.array([1, 2, 1]), np.array([0, 5, 9])
    before = pseudo_likelihood.log_probabilities(weights, windows, groups, slots).sum()
    for _ in range(5):
        trainer.step(windows, groups, slots)
    assert pseudo_likelihood.log_probabilities(trainer.weights, windows, groups, slots).sum() > before


def test_document_sums_equal_a_plain_recount(spark):
    """Every window trains in one of the rounds; the probabilities of all words of the corpus add up to one."""
    import pyarrow as pa

    q, rng = pseudo_likelihood, random.Random(6)
    texts = [" ".join(rng.choice("the of to".split()) if rng.random() < 0.5 else f"w{int(3000 * rng.random() ** 2)}" for _ in range(rng.randint(0, 160))) for _ in range(60)]
    docs = frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]).repartition(3).cache()
    words = q.vocabulary(q.count_table(docs))
    counts = Counter(w for t in texts for w in t.split())
    names = sorted(counts)
    hashes = np.concatenate([h for _, _, h, _ in q._hashed(pa.array([" ".join(names)]))])
    inputs, groups, slots, rare = (dict(zip(names, v.tolist(), strict=True)) for v in words.classes(hashes))
    assert 0 < sum(rare.values()) < len(names) and words.groups == q.groups_for(sum(counts.values()))
    assert min(counts[w] for w in names if not rare[w]) >= max(counts[w] for w in names if rare[w])
    rest = Counter()
    for w in names:
        if rare[w]:
            rest[groups[w]] += counts[w]
    weights = q.train(docs, words)
    assert sum(r[0] for r in docs.select("text").mapInArrow(seen_windows(words, weights), "n long").collect()) == sum(counts.values())

    def chances(around):
        h = np.tanh(np.concatenate([weights[0][i] for i in around]) @ weights[1] + weights[2])
        share = lambda z: np.exp(z) / np.exp(z).sum()
        first = share(h @ weights[3] + weights[4])
        second = [share(h @ weights[5][g] + weights[6][g]) for g in range(words.groups)]
        return lambda w: first[groups[w]] * second[groups[w]][slots[w]] * (counts[w] / rest[groups[w]] if rare[w] else 1)

    got = {r.doc_id: r for r in q.score(docs).collect()}
    some = chances([inputs[w] for w in names[:2]] + [words.edge] * 2)
    used = {(groups[w], slots[w]) for w in names}
    free = sum(np.exp(q.log_probabilities(weights, np.array([[inputs[w] for w in names[:2]] + [words.edge] * 2]), np.array([g]), np.array([k])))[0] for g in range(words.groups) for k in range(words.groups) if (g, k) not in used)
    assert sum(map(some, names)) + free == pytest.approx(1, abs=1e-4)
    for i in range(0, 60, 6):
        own = texts[i].split()
        pad = [words.edge] * q.SIDE + [inputs[w] for w in own] + [words.edge] * q.SIDE
        total = sum(np.log(chances(pad[k : k + q.SIDE] + pad[k + q.SIDE + 1 : k + 2 * q.SIDE + 1])(w)) for k, w in enumerate(own))
        assert got[i].n_words == len(own) and got[i].log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-6)


def seen_windows(words, weights):
    def run(batches):
        import pyarrow as pa

        batches = list(batches)
        rows = [r for k in range(pseudo_likelihood.ROUNDS) for b in pseudo_likelihood._learn(words, weights, k, pseudo_likelihood.ROUNDS)(iter(batches)) for r in b.column(2)[:1].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64())], ["n"])

    return run


# ---- op 8 ----------------------------------------------------------------------------------------


def test_quality_rules(spark, tables, odd):
    rng = random.Random(9)
    rows = list(odd) + [(100 + i, "\n".join(prose(rng, rng.randint(0, 9)) for _ in range(rng.randint(0, 30))) + rng.choice(["", " #$|<", "\n\n"]), "en", "a", 1) for i in range(60)]
    rows += [(300, "### $$$ ||| " * 60, "en", "a", 1), (301, "THE LOUD " * 90, "en", "a", 1)]
    for r in quality_rules.judge(frame(spark, rows)).collect():
        t = r.text or ""
        w = re.findall(WORD, t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r.kept and failed)
    assert quality_rules.judge(tables[1]).count() == 0
    symbols = " ".join(f"w{i}### the $$${i}" for i in range(100))
    clean = "The river runs under an old bridge in the north of this town. Every morning fishermen come to repair their nets and talk about weather. A woman sells bread from the window of a small house, and it is gone before noon. My father was a carpenter for forty years; he built most of the doors that you can see on our street. In winter the water is grey, for ice comes down from lakes far away. Children throw stones at it and count how often they jump. One of them once reached the other side, or so the story goes. Nobody believed him then. Today a train crosses where boats used to wait, and the ferry house is a museum with pictures of storms."
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, [(1, symbols, "en", "a", 1), (2, clean, "en", "a", 1)])).collect()}
    assert kept == {1: False, 2: True}


def test_repeated_windows_of_very_long_texts(spark):
    import time

    rng = random.Random(3)
    words = [f"w{rng.randrange(40_000)}" for _ in range(400_000)]
    words[100_000:100_500] = words[5_000:5_500]
    seen, covered = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    began = time.time()
    row = quality_rules.judge(frame(spark, [(1, " ".join(words), "en", "a", 1)])).first()
    assert (row.n_words, row.n_repeat_words) == (400_000, len(covered)) and time.time() - began < 60


# ---- op 10 ---------------------------------------------------------------------------------------


def brute_nearest(rows, k, every):
    good = {v: np.array(x) for v, x in rows if v is not None and x and None not in x and np.isfinite(x).all() and np.any(x) and len(x) == 8}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            scored = sorted((-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), v) for v, y in good.items() if v != q)
            out[q] = [(v, -s) for s, v in scored[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(v) for v in centres[i % 12] + 0.3 * rng.normal(size=8)]) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 8) for i in range(300)] + [(2000, [1.0] * 8), (None, [1.0] * 8), (3001, None), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [1.0, None] * 4), (3005, [1.0]), (3010, [float("inf")] * 8), (3006, [])]
    frame_ = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double").repartition(3)
    want, got = brute_nearest(dict(rows).items(), 5, 10), defaultdict(list)
    for r in ann.nearest(frame_, k=5, every=10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, answers in got.items():
        answers.sort()
        assert [a[0] for a in answers] == [1, 2, 3, 4, 5]
        assert [(-a[2], a[1]) for a in answers] == sorted((-a[2], a[1]) for a in answers)
        hits += len({a[1] for a in answers} & {v for v, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.9
    copies = got[2100]
    assert [a[1] for a in copies] == [2000, 2001, 2002, 2003, 2004]
    assert ann.nearest(frame_.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, every=50).collect()] == [(0, 3)]


def recall_of(spark, points, every, **how):
    """The share of exact answers found; every query must get five."""
    frame_ = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>").repartition(6)
    got = defaultdict(set)
    for r in ann.nearest(frame_, k=5, every=every, **how).collect():
        got[r.query_id].add(r.vec_id)
    asked = np.arange(0, len(points), every)
    assert set(got) == set(asked.tolist()) and {len(v) for v in got.values()} == {5}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    return np.mean([len(got[int(q)] & set(row.tolist())) / 5 for q, row in zip(asked, np.argsort(-near, axis=1)[:, :5], strict=True)])


def clustered(rng, n, isolated):
    centres = rng.normal(size=(400, 12))
    points = centres[rng.integers(0, 400, n)] + 0.35 * rng.normal(size=(n, 12))
    points[rng.choice(n, isolated, replace=False)] = rng.normal(size=(isolated, 12)) * 5
    return points


def test_recall_over_hundreds_of_lists_and_isolated_vectors(spark):
    assert recall_of(spark, clustered(np.random.default_rng(3), 52_000, 600), 100) >= 0.9


def test_recall_in_divided_lists(spark, monkeypatch):
    for name, value in (("LIST_SIZE", 32), ("MOST_CENTROIDS", 12), ("LONG", 100), ("LIST_LIMIT", 256), ("DIVIDE_EVERY", 4)):
        monkeypatch.setattr(ann, name, value)
    assert recall_of(spark, clustered(np.random.default_rng(4), 6_000, 200), 20) >= 0.9


def test_vectors_of_any_finite_length_take_part(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.99]), (3, [-1e300, 1e300]), (4, [5e-324, 0.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 4, 3] and found[0].score == pytest.approx(1) and found[3].score == pytest.approx(0)


# ---- registered queries --------------------------------------------------------------------------


def test_sql_of_queries(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        frame_ = registry.queries()[name](spark, sf)
        result = db.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(frame_.columns)
        got = sorted(tuple(round(r[c], 4) if isinstance(r[c], float) else r[c] for c in names) for r in frame_.collect())
        want = sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in result.fetchall())
        assert got == want, name


def test_digest_of_base_spans(spark):
    rows = registry.op2_disclosure_privacy(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base_of(texts[r.doc_id]).encode()).hexdigest()
