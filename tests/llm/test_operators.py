"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bpe, common, cotraining, exact_dedup, html_text, mixing, ngram_join, quality_rules, sharding, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, id string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = ["the", "of", "lorem", "ipsum", "dolor", "Amet", "x%%", "é", "sit."]
    texts = [None, "", " \n\t ", "one two", "one two", "One Two", "a b c d e", "A B C D E"] + [" ".join(rnd.choices(words, k=rnd.randint(1, 90))) for _ in range(30)]
    base = [f"w{i}" for i in range(100)]
    for i in range(12):
        near = list(base)
        near[rnd.randrange(100)] = f"n{i}"
        texts.append(" ".join(near))
    texts += [texts[-1]] * 9 + ["long " * 30_000]
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), "k", "s", "i") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def with_nulls(spark, rows):
    more = [(None, rows[-1][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows + more, DOCS)


@pytest.mark.parametrize("bits", [64, 3])
def test_dedup(spark, docs, rows, empty, bits):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows}
    assert {r[0]: tuple(r[1:5]) for r in exact_dedup.exact_dedup(docs, fingerprint_bits=bits).collect()} == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    odd = exact_dedup.exact_dedup(with_nulls(spark, rows)).where("doc_id IS NULL").collect()
    assert sorted((r.keep_id is None, r.kept) for r in odd) == [(False, False), (False, False)]


def test_quotient_filters_merge_without_loss():
    rnd = np.random.default_rng(1)
    parts = [rnd.integers(0, 500, 300).astype(np.uint64) * np.uint64(2**45 + 7) for _ in range(4)]
    decoded = [exact_dedup.decode_filter(exact_dedup.encode_filter(*np.unique(p, return_counts=True))) for p in parts]
    keys, counts = exact_dedup.merge_sorted(np.concatenate([k for k, _ in decoded]), np.concatenate([c for _, c in decoded]))
    assert dict(zip(keys.tolist(), counts.tolist())) == Counter(np.concatenate(parts).tolist())


def test_sharding(spark, docs, rows, empty):
    got = sharding.assign_shards(docs, 4, ranges=64, sample_rows=256).collect()
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    slots, where = defaultdict(list), defaultdict(set)
    text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.assign_shards(empty, 4).count() == 0
    even = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('text ', id) END AS text")
    loads = [r["b"] for r in sharding.assign_shards(even, 4, ranges=256, sample_rows=2000).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 4 and max(loads) < 1.1 * min(loads)
    assert sharding.assign_shards(with_nulls(spark, rows), 4).count() == len(rows) + 3
    # Few sampled keys leave overfull ranges, which are subdivided.
    loads = [r["b"] for r in sharding.assign_shards(even, 4, ranges=64, sample_rows=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 4 and max(loads) < 1.3 * min(loads)


def test_url_rules(spark):
    rules = [url_rules.SiteRule("allow", "org", "/"), url_rules.SiteRule("block", "example.org", "/es/"), url_rules.SiteRule("block", "example.org", "/en/1")]
    urls = [None, "", "nothing", "http://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2", "http://example.org", "http://badexample.org/es/", "http://spam.net/x", "x://y://z/w#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://spam.net/{i}", 1) for i in range(9)] + [(f"http://good.net/{i}", 0) for i in range(9)], "url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, labelled, rules, least_rows=4).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.org", "/es/1", "example.org/es/", "block"), 4: ("example.org", "/en/12", "example.org/en/1", "block"),
        5: ("example.org", "/en/2", "org/", "allow"), 6: ("example.org", "", None, "allow"), 7: ("badexample.org", "/es/", "org/", "allow"), 8: ("spam.net", "/x", None, "block"), 9: ("y:", "//z/w", None, "allow"),
    }
    assert url_rules.judge_urls(pages.limit(0), labelled.limit(0), rules).count() == 0


def test_url_rules_against_all_subsets(spark):
    """Mined rules against every set of up to three tokens, with tokens that always go together, repeated and null URLs and clashing columns."""
    from itertools import combinations

    rnd = random.Random(15)
    urls = [f"http://{rnd.choice(['a.net', 'b-c.net', 'd.org'])}/{rnd.choice(['x/y', 'x', 'z'])}/{rnd.choice(['p', 'q', ''])}?{rnd.choice(['k=1&m=2', 'k=2', 'n'])}" for _ in range(120)]
    rows = [(u, int(("b-c" in u and "/z" in u) or rnd.random() < 0.15)) for u in urls]
    labelled = spark.createDataFrame(rows, "url string, bad int")
    tokens = {r.url: set(r.t) for r in labelled.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    counts = defaultdict(lambda: [0, 0])
    for u, bad in rows:
        for k in (1, 2, 3):
            for own in combinations(sorted(tokens[u]), k):
                counts[own][0] += bad
                counts[own][1] += 1
    for confidence in (0.1, 0.6):
        rules = [set(own) for own, (p, n) in counts.items() if p >= 4 and p >= confidence * n]
        pages = spark.createDataFrame([(i, u, "v", "r") for i, u in enumerate([*urls, urls[0], None, None, "none/"])], "page_id long, url string, verdict string, host string")
        got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labelled, [], least_rows=4, support=0.001, confidence=confidence).collect()}
        assert len(got) == len(urls) + 4
        assert all(got[i] == ("block" if any(rule <= tokens[u] for rule in rules) else "allow") for i, u in enumerate([*urls, urls[0]]))
        assert {got[i] for i in range(len(urls) + 1, len(urls) + 4)} == {"allow"}


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered, seen, repeats = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered)


def test_statistics(spark, rows, docs, empty):
    more = ["a b c a b c", "a a a a", "x\n\nx\n x\nx", "\x0b a\x0cb \r\n a", "é ü  é |<>", "a b c d a b c"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = quality_rules.with_statistics(frame).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert all(tuple(r[1:]) == brute_statistics(r[0]) for r in got)
    assert quality_rules.judge(empty, []).count() == 0


def test_rules_find_the_threshold(spark):
    rnd = random.Random(5)
    data = [(i, rnd.random(), rnd.random()) for i in range(600)]
    frame = spark.createDataFrame([(i, a, b, int(a > 0.7 and b > 0.4)) for i, a, b in data], "doc_id long, a double, b double, bad int")
    rules = quality_rules.learn_rules(frame, ("a", "b"), thresholds=39)
    kept = {r.doc_id for r in frame.where(quality_rules.decision_list(rules)).collect()}
    wrong = sum((i in kept) == (a > 0.7 and b > 0.4) for i, a, b in data)
    assert rules and wrong <= 25
    assert quality_rules.learn_rules(frame.limit(0), ("a", "b")) == []
    assert quality_rules.learn_rules(frame.withColumn("bad", F.lit(0)), ("a", "b")) == []


def test_html():
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/a>menu</a></ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one <b>two\n three</b><br><p>caf&eacute;</p><ul><li>x</li><li>y</li></ul><section id='comments'><p>no</p></section></article><footer>f</footer>"
    assert html_text.main_text(page) == "A & B\none two three\ncafé\nx\ny"
    assert html_text.main_text("") == "" and html_text.main_text("<p>a") == "a" and html_text.main_text("<p>a</p") == "a"
    bare = "<div class=top><a href=1>l1</a> <a href=2>l2</a></div><div><h1>T</h1>" + "<p>Some words, and more; here.</p>" * 5 + "</div><div><a href=3>other things</a></div>"
    assert html_text.main_text(bare) == "T\n" + "\n".join(["Some words, and more; here."] * 5)


@pytest.mark.parametrize("opened, closed", [
    ("<html class='no-js cookies'><body>", ""), ("<body class='has-sidebar'>", "</body>"), ("<body class='sidebar'>", "</body>"), ("<article class='post comments-open'>", "</article>"), ("<article class='related'>", "</article>"),
    ("<div class='layout-no-sidebar'>", "</div>"), ("<div class='sidebar'><article>", "</article></div>"), ("<div id='search'>", "</div>"),
])
def test_html_wrappers_stay(opened, closed):
    page = f"<div class='ad-slot'>buy</div>{opened}<h2 id='related-work'>Work</h2><section id='search-algorithms'><p>Some text, that is long.</p></section><p>More of it, and more.</p><div class='social-links'>s</div>{closed}"
    assert html_text.main_text(page) == "Work\nSome text, that is long.\nMore of it, and more."


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "<p>x &lt; y</p>"), (2, "u", "<p>x &lt; y</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url, r.text) for r in html_text.extract_pages(pages).collect() if r.url) == [(2, "u", "x < y")] * 2
    assert html_text.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("units", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 7, "b": 1, "*": 3}])
def test_schedule_deviates_by_less_than_a_block(units):
    period, seen = sum(units.values()), Counter()
    for stream, k, slot, release, due in mixing.pfair_period(units):
        seen[stream] += 1
        assert release <= slot < due and k == seen[stream]
        assert all(abs(Fraction(u * (slot + 1), period) - seen[s]) < 1 for s, u in units.items())
    assert seen == units


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs, {"src0": 2, "src1": 1}, 2).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows] and len({(r.slot, r.seat) for r in got}) == len(rows)
    assert {r.stream for r in got} == {"src0", "src1", "*"} and mixing.mix(empty, {"src0": 1}).count() == 0
    assert mixing.mix(with_nulls(spark, rows), {"src0": 1}).count() == len(rows) + 3
    # Rows with one id get the same seats however they are dealt.
    again = spark.createDataFrame([(1, f"t{i}", f"s{i % 3}") for i in range(40)], "doc_id long, text string, source string")
    seats = [sorted((r.text, r.slot, r.seat) for r in mixing.mix(f, {"s0": 1}, 2, keep=["text"]).collect()) for f in (again.repartition(5), again.coalesce(1))]
    assert seats[0] == seats[1]


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("options", [{}, {"short_list": 2, "frequent": 3}, {"cell_shingles": 300, "cut": 0.1}, {"order_docs": 0, "cut": 0.9}, {"cell_shingles": 50, "wide_shingles": 400, "pivots": 0}])
def test_join(docs, rows, options):
    got = {r[0]: tuple(r[1:]) for r in ngram_join.jaccard_components(docs, **options).collect()}
    assert got == brute_components(rows)


def test_join_edges(spark, rows, empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    odd = ngram_join.jaccard_components(with_nulls(spark, rows)).collect()
    assert len(odd) == len(rows) + 3 and all(r.component_id is None for r in odd if r.doc_id is None)


def test_join_with_a_null_copy_ahead(spark):
    text = [f"w{i}" for i in range(60)]
    near = text[:-1] + ["other"]
    frame = spark.createDataFrame([(None, " ".join(text)), (5, " ".join(text)), (9, " ".join(near))], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame).collect()}
    assert got == {None: None, 5: 5, 9: 5}


def test_heap_merge_counts():
    rnd = random.Random(6)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(60), rnd.randint(1, 40))) for _ in range(rnd.randint(1, 9))]
        counts = Counter(x for own in lists for x in own)
        for least in range(1, len(lists) + 1):
            assert list(ngram_join.heap_merge(lists, least)) == sorted((x, n) for x, n in counts.items() if n >= least)


def test_components_with_hubs(spark):
    from codeloom.llm.components import components

    rnd = random.Random(4)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(60)] + [(rnd.randrange(7000, 9000), rnd.randrange(7000, 9000)) for _ in range(900)] + [(None, 3), (4, 4)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            x, y = sorted((find(u), find(v)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("words", [4096, 2])
def test_filter_before_a_join_keeps_what_is_wanted(spark, words):
    rows = spark.range(-500, 4500).select(F.col("id"), F.lit("x").alias("text")).union(spark.sql("SELECT CAST(NULL AS LONG), 'y'"))
    wanted = spark.range(-500, 4500, 7).select("id").union(spark.sql("SELECT 2L UNION ALL SELECT CAST(NULL AS LONG)"))
    found = common.may_be_in(rows, wanted, "id", words)
    assert found.columns == ["id", "text"]
    kept = [r["id"] for r in found.collect()]
    assert set(range(-500, 4500, 7)) | {2} <= set(kept) and len(kept) == len(set(kept)) and None not in kept
    assert words == 2 or len(kept) < 800  # 715 are wanted
    rest = common.without(rows, wanted, "id", words)
    assert rest.columns == ["id", "text"]
    assert sorted(r["id"] or -9999 for r in rest.collect()) == sorted([-9999 if i == 0 else i for i in range(-500, 4500) if (i + 500) % 7 and i != 2] + [-9999])


def test_search_finds_every_link():
    rnd = random.Random(9)
    sets = []
    for _ in range(8):
        base = rnd.sample(range(400), 60)
        sets += [np.array(sorted(set(base[: rnd.randint(45, 60)] + rnd.sample(range(400, 800), rnd.randint(0, 12)))), np.uint64) for _ in range(6)]
    index = ngram_join.CellIndex(sets, 75)
    for q, a in enumerate(sets):
        want = [j for j, b in enumerate(sets) if j != q and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))]
        assert sorted(set(index.search(a).tolist()) - {q}) == want


def test_bpe(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'’ \n\tABCÉßΣσς0123!?#$%\x1c\x1f\x85\xa0\u0301\u0300日🙂"
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>B<|endoftext|>", "ΑΣ İ", "don't I'll", "a" * 3000, "#" * 700, "日本語 テスト"] + ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(300)]
    texts += ["".join(rnd.choices("aeiounrst", k=400)) for _ in range(5)]
    # Long words, words of repeated pairs, and every code point beyond ASCII that is assigned late or not at all.
    texts += ["".join(rnd.choices("aeiounrst", k=20_000)), "abc" * 9000, "thethethe" * 500] + ["".join(rnd.choices(["the", "er", "in", "a", "n"], k=150)) for _ in range(50)]
    texts += ["".join(f"a{chr(c)}1{chr(c)}b " for c in range(top, top + 64)) for low, high in ((0x500, 0x600), (0x1C80, 0x1CC0), (0xA780, 0xA800), (0x10D00, 0x10F00), (0x16D00, 0x16F00), (0x323C0, 0x32440)) for top in range(low, high, 64)]
    coder = bpe.WordBpe(path, cache_words=50)
    for _ in range(2):
        for text, (ids, decoded) in zip(texts, coder.encode_batch(texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.encode_documents(docs, path, step_bytes=1000).collect()}
    assert all(np.frombuffer(got[i][0], "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows)
    assert bpe.encode_documents(empty, path).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(7)
    plain = ["table", "river", "stone", "cloud", "paper", "green", "quiet", "under", "seven", "light"]
    data = []
    for i in range(400):
        words = rnd.choices(plain, k=40) + [f"w{rnd.randrange(3000)}" for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            words += rnd.sample(["idiot", "moron", "stupid"], 2)
        rnd.shuffle(words)
        data.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(data, "doc_id long, text string, toxic int").cache()


def test_toxicity(spark, judged):
    train, held = judged.where("doc_id % 3 <> 1"), judged.where("doc_id % 3 = 1")
    model = toxicity.learn(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    assert {"idiot", "moron", "stupid"} <= set(model.weights)
    scored = toxicity.score_documents(held, model).join(held.select("doc_id", "toxic"), "doc_id").collect()
    assert all((r.score >= 0.7) == (r.toxic == 1) for r in scored)
    for text in ("you 1d10t", "m o r o n here", "so stuuuupid", "an id!ot", "i.d.i.o.t"):
        assert toxicity.Reader(model.weights, model.letters).words(text), text
    assert not toxicity.Reader(model.weights, model.letters).words("the table!! 2024 of%%% green")
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score < 0.7 for r in toxicity.score_documents(odd, model).collect())
    none = toxicity.learn(judged.limit(0), judged.limit(0))
    assert toxicity.score_documents(odd, none).count() == 3


def test_decode_is_the_best_of_all_paths():
    """Viterbi against every way to read the characters."""
    rnd = random.Random(12)
    letters = toxicity.CharacterModel.of({"idiot": 9, "stone": 20, "boat": 5, "beet": 7, "letter": 4, "sold": 3, "soul": 2})

    def value(path, cost):
        padded = f"^^{path}$"
        return cost + sum(letters.step(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))

    for _ in range(150):
        observed = "".join(rnd.choices("stoneidbl013!$*.-", k=rnd.randint(1, 5)))
        ways, previous = [("", 0.0)], ""
        for c in observed:
            options = [(c, 0.0)] if c.isalpha() else [(x, -1.0) for x in toxicity.LOOKALIKES.get(c, "")] or ([(x, -3.0) for x in "abcdefghijklmnopqrstuvwxyz"] if c == "*" else [])
            skip = -0.5 if c == previous or not (c.isalnum() or c in toxicity.LOOKALIKES) else None if c.isalpha() else -4.0
            ways = [(p + x, s + w) for p, s in ways for x, w in options] + ([(p, s + skip) for p, s in ways] if skip is not None else [])
            previous = c
        best = max(value(p, s) for p, s in ways)
        found = toxicity.decode(observed, letters)
        assert max(value(p, s) for p, s in ways if p == found) == pytest.approx(best), observed


def test_toxicity_edges(spark, judged):
    import time

    model = toxicity.learn(judged.select("doc_id", "text"), judged.select("doc_id", "toxic"))
    began = time.time()
    assert toxicity.decode("id" + "*" * 100_000 + "ot", model.letters)
    toxicity.Reader(model.weights, model.letters).words("a" * 200_000 + " " + "st0ne" * 20_000)
    assert time.time() - began < 60
    odd = spark.createDataFrame([(5, "the river", 0, "a"), (5, "you idiot moron", 1, "b"), (None, "stupid moron", 1, None)], "doc_id long, text string, toxic int, score string")
    got = sorted((str(r.doc_id), r.score >= 0.7) for r in toxicity.score_documents(odd, model).collect())
    assert got == [("5", False), ("5", True), ("None", True)]
    clean = toxicity.score_documents(judged.where("toxic = 0"), model).collect()
    assert len({r.score for r in clean}) > 20  # texts without toxic words are ranked, too
    assert toxicity.learn(odd, odd.select("doc_id", "toxic")).letters.three


def test_toxicity_learns_from_rows_that_share_a_word(spark):
    import xxhash

    rnd = random.Random(11)
    words = sorted((f"{a}{b}{c}word" for a in "bdfg" for b in "aeiou" for c in "lmnr"), key=lambda w: xxhash.xxh3_64_intdigest(w))
    shared, plain = words[0], [w for w in words[1:] if xxhash.xxh3_64_intdigest(w) < xxhash.xxh3_64_intdigest("vileness")] + words[-20:]
    data = [(i, " ".join([shared, *rnd.sample(plain, 10)] + ["vileness"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(160)]
    data += [(1000 + i, f"{shared} copied passage {'again ' * (i % 3)}again", 1) for i in range(60)]
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.learn(frame, frame.select("doc_id", "toxic"))
    assert set(model.weights) == {"vileness"}


def test_toxicity_reads_letters_of_all_documents(spark, judged):
    more = spark.createDataFrame([(10_000 + i, "the xylophone plays") for i in range(50)], "doc_id long, text string")
    docs = judged.select("doc_id", "text").union(more)
    model = toxicity.learn(docs, judged.select("doc_id", "toxic"))
    assert toxicity.decode("xy1ophone", model.letters) == "xylophone" and {"idiot", "moron", "stupid"} <= set(model.weights)
    counts, rows = toxicity.letter_statistics(more.union(spark.createDataFrame([(1, None), (2, "a1d10t so stuuupid")], more.schema)))
    want = toxicity.trigrams({"the": 50, "xylophone": 50, "plays": 50, "so": 1})
    assert rows == 52 and counts == want


def test_co_training():
    rnd = np.random.default_rng(2)
    y = rnd.integers(0, 2, 600).astype(float)
    text, meta = rnd.normal(size=(600, 6)) + y[:, None], rnd.normal(size=(600, 4)) + 0.8 * y[:, None]
    model = cotraining.co_train(text[:100], meta[:100], y[:100], text[100:300], meta[100:300])
    score = model.scores(text[300:], meta[300:])
    right = [float(((s >= 0.5) == (y[300:] == 1)).mean()) for s in score]
    assert right[2] > 0.85 and right[2] >= max(right[:2]) - 0.03
    assert cotraining.co_train(text[:3], meta[:3], y[:3], text[:0], meta[:0]).scores(text[:2], meta[:2])[2].tolist() == pytest.approx([(y[:3].sum() + 0.5) / 4] * 2)


def test_exchange_passes_both_labels_or_none():
    rnd = np.random.default_rng(0)
    y = (rnd.random(2500) < 0.6).astype(float)
    text, meta = rnd.normal(size=(2500, 30)), rnd.normal(size=(2500, 30))
    noise = rnd.normal(size=(2500, 30))
    text[:, :6] += 1.1 * y[:, None]
    meta[:, :6] += 1.1 * y[:, None]

    def right(model, other):
        return [float(((s >= 0.5) == (y[1500:] == 1)).mean()) for s in model.scores(text[1500:], other[1500:])]

    made = [cotraining.co_train(text[:100], meta[:100], y[:100], text[100:1500], meta[100:1500], rounds=n) for n in (0, 5)]
    assert made[0].passed == [[0, 0], [0, 0]] and all(bad > 0 and good > 0 for bad, good in made[1].passed)
    assert all(b > a for a, b in zip(right(made[0], meta), right(made[1], meta)))
    weak = cotraining.co_train(text[:100], noise[:100], y[:100], text[100:1500], noise[100:1500])
    assert weak.passed[1] == [0, 0]


def test_quality_frames(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = cotraining.train(docs, labels)
    got = cotraining.score_quality(with_nulls(spark, rows), model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    repeated = docs.union(docs).withColumn("score", F.lit("x"))
    assert cotraining.score_quality(repeated, cotraining.train(repeated, labels)).count() == 2 * len(rows)
    assert cotraining.score_quality(empty, cotraining.train(empty, labels.limit(0))).count() == 0


PROSE = ["The first paragraph says a few things, and then some more.", "A second one, which is longer than the first; it goes on for a while, as such texts do.", "Short one.", "The last words of it all, at least here."]
LAYOUTS = [
    "<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div class=story>{text}</div><div class=rail><a href=3>Another story here</a><br><a href=4>More</a></div></body>",
    "<body><table><tr><td class=l><a href=1>Home</a><p><a href=2>News</a></td><td class=m>{text}</td><td class=r><ul><li><a href=3>Another</a><li><a href=4>More</a></ul></td></tr></table></body>",
    "<body><main><div id=content>{text}</div></main><section class=comments><article><p>I do not agree with any of this, at all.</p></article></section></body>",
    "<body><form id=aspnet><input type=hidden><div><a href=1>Home</a></div><div class=c>{text}</div></form></body>",
    "<body class=has-sidebar><nav>Home, News, and all the rest of it<article>{text}<aside><p>Related, and also good: this.</p></aside></article><footer>Copyright, us.",
    "<body><header><h1>Site</h1></header><section><div><div>{text}</div></div></section><div class=cookie-notice><p>We use cookies, as all do.</p></div><script>x='<p>no</p>'</script></body>",
    "<body><div><a href=1>One</a></div><article><div hidden>secret, hidden.</div>{text}<div class=share-buttons><a href=x>Tell a friend</a></div><ul class=tags><li><a href=t>tag</a></li></ul></article></body>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_layouts(layout):
    marked = "".join(f"<p>{p}</p>" for p in PROSE)
    assert html_text.main_text(f"<html><head><title>t</title></head>{layout.format(text=marked)}</html>") == "\n".join(PROSE)


def brute_paths(blocks, strength):
    """Which of (path, text, link share) blocks hold content, by the definition, one block after the other."""
    paths = [b[0] for b in blocks]
    length, marks = ({p: sum(f(t) for q, t, _ in blocks if q == p) / paths.count(p) for p in paths} for f in (len, lambda t: len(re.findall("[.,;:!?]", t))))
    share = {p: sum(len(t) * s for q, t, s in blocks if q == p) / sum(len(t) for q, t, _ in blocks if q == p) for p in paths}

    def smooth(values, i):
        return (values[max(0, i - 1)] + 2 * values[i] + values[min(len(values) - 1, i + 1)]) / 4

    fused = [(smooth([length[p] for p in paths], i) * (1 + smooth([marks[p] for p in paths], i))) ** 0.5 * (1 - share[p]) for i, p in enumerate(paths)]
    mean = {p: sum(f for f, q in zip(fused, paths) if q == p) / paths.count(p) for p in paths}
    spread = (sum((f - sum(fused) / len(fused)) ** 2 for f in fused) / len(fused)) ** 0.5
    return [mean[p] >= min(strength * spread, max(mean.values())) and mean[p] > 0 for p in paths]


def test_html_thresholds_paths():
    rnd = random.Random(8)
    for _ in range(60):
        blocks = [(rnd.choice(["h2", "p", "blockquote", "pre"]), " ".join(rnd.choices(["word", "other,", "third.", "x"], k=rnd.choice([1, 2, 30]))), 0) for _ in range(rnd.randint(2, 12))]
        blocks += [("h3", "linked words here", 1)] * rnd.randint(0, 2)
        page = "<article>" + "".join(f"<{p}>{'<a href=x>' * s}{t}{'</a>' * s}</{p}>" for p, t, s in blocks) + "</article>"
        for strength in (0, 0.5, 1, 2, 1e9):
            passed = brute_paths(blocks, strength)
            ends = [i for i, x in enumerate(passed) if x]
            want = [t for i, (_, t, s) in enumerate(blocks) if passed[i] or ends[0] < i < ends[-1] and s < 0.5]
            assert html_text.main_text(page, strength) == "\n".join(want)


def test_html_is_linear():
    import time

    began = time.time()
    for page in ("<div>x" * 100_000, "<nav><ul>" + "<li class=ad><a href=x>y" * 50_000, '<a "' * 100_000, "<p class='x" * 50_000, "<b>x" * 100_000, "<td><p>x" * 50_000):
        html_text.main_text(page)
    assert time.time() - began < 60


def test_merged_arrays_count_as_the_heap(monkeypatch):
    """Many lists merged as arrays give what the heap gives, and a search over a cell of loosely linked sets takes a small part of the heap's time."""
    import time

    import numpy as np

    rnd = random.Random(3)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(30), rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 14))]
        sizes = np.array([len(x) for x in lists])
        ends = np.cumsum(sizes)
        flat = np.array([x for held in lists for x in held], np.int32)
        for least in range(1, len(lists) + 1):
            found, counts = ngram_join.merged(flat, ends - sizes, ends, least)
            assert list(zip(found.tolist(), counts.tolist())) == list(ngram_join.heap_merge(lists, least))
    sets = [np.unique(np.array([rnd.randrange(3000) for _ in range(300)], np.uint64)) for _ in range(1000)]
    sets += [s[: len(s) - k] for k, s in enumerate(sets[:40])]
    index, took, got = ngram_join.CellIndex(sets, 75), {}, {}
    for lists in (1_000_000, ngram_join.HEAP_LISTS):
        monkeypatch.setattr(ngram_join, "HEAP_LISTS", lists)
        at = time.perf_counter()
        got[lists] = [index.search(s).tolist() for s in sets[:60]]
        took[lists] = time.perf_counter() - at
    assert got[1_000_000] == got[lists] and any(len(x) > 1 for x in got[lists]) and took[lists] < took[1_000_000] / 2, took


_IDLE = """
import re

import pyarrow as pa

from codeloom.llm.common import sparing, steps
from codeloom.llm.ngram_join import Shingler


def held_mb():
    return int(re.search(r"Pss_Anon:\\s+([0-9]+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024


def run(batches):
    shingler = kept[0]
    for part in steps(batches, "text"):
        yield len(shingler.sets(part.column("text").to_pylist()))


kept = [Shingler(5)]
list(sparing(run)(iter([pa.RecordBatch.from_arrays([pa.array(["a b c d e f"])], ["text"])])))
before = held_mb()
texts = [" ".join(f"{(i * 400 + k) * 2654435761 % 2**32:08x}" for k in range(400)) for i in range(4000)]
list(sparing(run)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
del texts
print(held_mb() - before)
"""


def test_shingling_leaves_no_memory_behind():
    """Idle workers count as their executor's memory: 1.6 million words that differ must not stay in one."""
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", _IDLE], capture_output=True, text=True, timeout=300, check=True)
    assert float(done.stdout) < 50


def test_encoder_keeps_ids_alone(spark):
    """What a cached word decodes to is not kept a second time, and a session's batch size comes back."""
    import public_tokenizers

    from codeloom.llm.common import small_batches

    coder = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    coder.encode_batch(["some words of a text"])
    assert [k for k, v in vars(coder).items() if isinstance(v, dict) and "words" in v] == ["ids"]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with small_batches(spark):
        assert spark.conf.get(key) == "1000"
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "20")
    with small_batches(spark):
        assert spark.conf.get(key) == "20"
    assert spark.conf.get(key) == "20"
    spark.conf.unset(key)


@pytest.mark.parametrize("short_list", [1, 3, 24])
def test_hook_lists_count_pairs(short_list):
    rnd = random.Random(8)
    lists = {s: sorted(rnd.sample(range(-40, 40), rnd.choice([1, 2, 3, 5, 30]))) for s in (rnd.randrange(-(2**62), 2**62) for _ in range(300))}
    rows = [(a, s, 0) for s in sorted(lists) for a in lists[s]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 97]), (pa.int64(), pa.int64(), pa.int32()))], ["a", "s", "part"]) for i in range(0, len(rows), 97)]
    got = pa.Table.from_batches(list(ngram_join.hook_lists(iter(batches), short_list))).to_pylist()
    pairs = Counter((b, a) for own in lists.values() if len(own) <= short_list for k, b in enumerate(own) for a in own[:k])
    assert Counter({(r["u"], r["v"]): r["n"] for r in got if r["kind"] == ngram_join.PAIR}) == pairs
    assert all(r["n"] > 0 for r in got)
    hooked = Counter()
    for r in got:
        if r["kind"] == ngram_join.HOOK:
            hooked[r["u"]] += r["n"]
    assert hooked == Counter(a for own in lists.values() if len(own) > short_list for a in own)
