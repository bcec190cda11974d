"""Worked examples at the edges of the rules."""

import random
from collections import Counter

from pyspark.sql import functions as F

from loam.functions import normal
from loam.functions import text as T
from loam.operators import blocks, dedup, gates, history, instruct, lines, matching, packing, scoring, splits
from loam.operators.components import connected_components
from loam.operators.grouping import first_k, first_rows, ranked, with_group_values
from loam.plans import prepare


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_canonical(spark):
    assert one(spark, "a\r\nb  \n\n\n\nc​\x07", T.canonical) == "a\nb\n\nc"
    assert one(spark, "# MD5: " + "0" * 32 + "\nbody", T.canonical) == "body"
    assert one(spark, None, T.canonical) is None


def test_compatibility_form(spark):
    assert one(spark, "ﬁ  ", normal.normalised) == "fi"


def test_length_and_repetition(spark):
    cfg = gates.GateConfig()
    assert one(spark, " " + "x" * 49 + " ", lambda c: gates.length_of(c, cfg)) == 49
    seven = "\n\n".join(map(str, [1, 2, 3, 4, 5, 6, 7, 1, 2, 3]))
    assert one(spark, seven, lambda c: gates.repetition_ratio(c, cfg)) == 0.3
    assert one(spark, "", lambda c: gates.repetition_ratio(c, cfg)) == 1.0
    second = gates.GateConfig(fold_case=False, empty_repetition=0.0)
    assert one(spark, "", lambda c: gates.repetition_ratio(c, second)) == 0.0
    assert one(spark, "A b\n\na  B", lambda c: gates.repetition_ratio(c, cfg)) == 0.5
    assert one(spark, "A b\n\na  B", lambda c: gates.repetition_ratio(c, second)) == 0.0


def test_gates_on_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "k bigint, t string")
    assert {r.reason for r in gates.gate_reasons(docs, "k", "t").collect()} == {"length"}
    assert gates.gate_reasons(docs.where("k > 9"), "k", "t").count() == 0


def test_page_edges(spark):
    page = "The Running Title Of This Book\none line\ntwo lines\nthree lines"
    cut = lambda n: one(spark, "\n\n".join([page] * n), blocks.remove_page_edges)
    assert cut(3) == "\n\n".join(["one line\ntwo lines\nthree lines"] * 3)
    assert cut(2) == "\n\n".join([page] * 2)


def test_urls(spark):
    assert one(spark, "See http://a.b/c.", lines.remove_urls) == ""
    assert one(spark, "Please read the notes at http://a.b, then stop", lines.remove_urls) == "Please read the notes at , then stop"
    assert one(spark, "a [label](http://x.y/z) b", lines.remove_urls) == "a label b"


def test_certificates(spark):
    text = "-----BEGIN A-----\nx\n-----BEGIN B-----\ny\n-----END B-----\nz"
    cfg = lines.LineConfig(min_chars=0)
    assert one(spark, text, lambda c: lines.post_clean(c, cfg)) == "z\n"
    counted = dict(spark.createDataFrame([(text,)], "t string").select(F.explode(lines.actions(F.col("t"))).alias("a")).select("a.*").collect())
    assert (counted["pem_blocks_removed"], counted["pem_payload_lines_removed"]) == (2, 3)


def test_post_clean_keeps_short_originals(spark):
    assert one(spark, "http://only.example/x", lines.post_clean) == "http://only.example/x"


def test_content_cleaner():
    kind, text, log = blocks.clean_document("C H A P T E R 1\n\nA line that was wrap-\nped at its end\nand goes on.\n\n| a | b |\n| 1 x | 2 y |\n| 3 z | 4 w |")
    assert kind == "generic" and text.split("\n\n")[:2] == ["Chapter 1", "A line that was wrapped at its end and goes on."]
    assert "| a | b |\n| --- | --- |\n| 1 x | 2 y |" in text
    block = "word " * 40
    assert [x[2] for x in blocks.clean_document(f"{block}\n\n{block}")[2]] == [None, "duplicate_block"]
    assert blocks.clean_document(None) == ("generic", "", [])
    commands = "\n".join(f"show item {i}" for i in range(200))
    assert len(blocks.clean_document(commands)[1].split("\n")) == 162


def test_fences_and_spaced_headings(spark):
    long = "\n".join(f"show item {i}  " for i in range(200))
    assert tuple(one(spark, long, blocks.fenced)) == ("```text\n" + "\n".join(f"show item {i}" for i in range(160)) + "\n```", 40)
    for line in ("C H A P T E R 1", "  O v e r v i e w ", "A B", "Plain words", "N o t e  12 ", ""):
        assert one(spark, line, blocks.unspaced_heading) == blocks.unspaced(line)


def test_front_matter():
    toc = ["Table of Contents", *[f"{i}. x" for i in range(6)], "1.  Introduction", "body"]
    assert blocks.front_ranges(toc, "rfc") == [(0, 7, "table_of_contents")]
    assert blocks.front_ranges(["Status of this memo", "x", "Abstract"], "rfc") == [(0, 2, "rfc_status_and_legal")]


def test_paragraphs(spark, rows):
    prose, short = "y" * 200, "z" * 100
    docs = spark.createDataFrame([(1, f"{prose}\n\n{short}"), (2, f"{prose}\n\n{short}"), (3, None)], "k bigint, t string")
    kept = dedup.paragraph_dedup(docs, "k", "t").select("k", "pos", "kind", "kept")
    assert rows(kept) == [(1, 1, "prose", True), (1, 2, "short", True), (2, 1, "prose", False), (2, 2, "short", True)]


def brute_greedy(n, edges):
    kept = {}
    for k in range(n):
        kept[k] = not any(kept[a] for a, b in edges if b == k)
    return sorted(kept.items(), key=repr)


def test_greedy(spark, rows):
    rng = random.Random(3)
    for n, m in ((3, 2), (25, 40)):
        edges = [(0, 1), (1, 2)] if n == 3 else sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        nodes = spark.range(n).withColumnRenamed("id", "k")
        got = dedup.greedy_keep(nodes, "k", spark.createDataFrame(edges, "a bigint, b bigint"))
        assert rows(got) == brute_greedy(n, edges)


def test_two_keys(spark):
    pairs = spark.createDataFrame([(1, "i1", "r1"), (2, "i1", "r2"), (3, "i2", "r2")], "o int, i string, r string")
    assert sorted(r.o for r in dedup.two_key_dedup(pairs, ["o"], F.col("i"), F.col("r")).collect()) == [1, 3]


def test_components(spark, rows):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7), (1, 2), (2, 1)]
    label = list(range(60))
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert rows(got) == sorted(((k, label[k]) for k in {x for e in edges for x in e}), key=repr)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_all_pairs_of_signatures(spark, rows):
    """Equal signatures, hot bands and pairs just at the threshold: every pair that agrees, whatever path finds it."""
    rng = random.Random(4)
    notice = [rng.randrange(1000) for _ in range(40)]
    signed = []
    for k in range(120):
        own = [rng.randrange(10**6) for _ in range(64)]
        if k % 3 == 0:
            own[:40] = notice  # a third shares most places, and still does not agree by the threshold
        signed.append((10 * k, list(own)))
        if k % 4 == 0:
            signed += [(10 * k + 1, list(own)), (10 * k + 2, [v if i >= k // 12 else -1 for i, v in enumerate(own)])]
    want = sorted((a, b) for i, (a, x) in enumerate(signed) for b, y in signed[i + 1 :] if sum(p == q for p, q in zip(x, y)) >= 0.85 * 64)
    df = spark.createDataFrame(signed, "id bigint, signature array<bigint>")
    for hot in (1000, 5):
        got = dedup.similar_pairs(df, "id", hot=hot)
        assert sorted((r.a, r.b) for r in got.collect()) == want and len(want) > 60
    few = dedup.candidate_pairs(df, "id", 0.85, hot=5)
    assert few.count() < 3 * len(want)  # pairs through the notice would be 800 and more


def test_long_chains_end(spark):
    """No round is the last before everything is decided."""
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    short = chain.where("a < 24")
    got = dedup.greedy_keep(spark.range(25), "id", short).collect()
    assert {r.id for r in got if r.kept} == set(range(0, 25, 2)) and len(got) == 25


def test_held_out_size(spark):
    for n, want in ((25, 2), (35, 4), (2, 1)):
        assert one(spark, n, lambda c: splits.held_out_size(c, 10), "bigint") == want


def test_largest_remainder(spark, rows):
    sizes = spark.createDataFrame([("a", 6), ("b", 4)], "s string, n bigint")
    assert rows(splits.largest_remainder(sizes, "s", "n", 0.25)) == [("a", 6, 1), ("b", 4, 1)]


def test_sources_skip_when_too_little_is_left(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 1), ("c", 4)], "s string, n bigint")
    # a would leave too little; after b the target is met, but two sources are wanted and c leaves too little
    assert [tuple(r) for r in splits.choose_sources(sizes, "s", "n", 0.1, 0.6, ("a", "b")).collect()] == [("b", 0)]
    assert splits.choose_sources(sizes.limit(0), "s", "n", 0.1, 0.6).count() == 0


def test_fragments_joined_or_broadcast(spark, rows):
    texts = spark.createDataFrame([("alpha_beta",), ("beta_gamma",), ("delta",), (None,), ("",), ("aab",)], "name string")
    parts = spark.createDataFrame([("alpha",), ("beta",), ("gam",), ("a",), ("",), (None,), ("longer than any",)], "part string")
    want = sorted((t, p) for t in ("alpha_beta", "beta_gamma", "delta", "aab") for p in ("alpha", "beta", "gam", "a") if p in t)
    for small in (1000, 2):
        assert rows(matching.containing(texts, "name", parts, "part", small)) == want
    assert rows(matching.only_text(parts.withColumn("k", F.length("part")), "k", "part", texts, "name")) == [(3, "beta_gamma"), (5, "alpha_beta")]


def test_packing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f g")], "k bigint, t string")
    ids = packing.word_ids(F.col("t"))
    m = packing.pack_metrics(packing.spans(docs, "k", ids, 4), 4).first()
    assert (m.stream_tokens, m.sequences, m.residual_tokens) == (9, 2, 1)
    wide = packing.spans(docs, "k", ids, 4, bos=True).orderBy("k").collect()
    assert [r.truncated for r in wide] == [False, True] and wide[-1].stream_end == 11
    assert packing.pack(docs.where("k > 5"), "k", ids, 4).count() == 0
    assert packing.pack(docs, "k", ids, 4).count() == 2


def test_dtype(spark):
    assert [one(spark, n, packing.narrowest_dtype, "bigint") for n in (65535, 65536, 1 << 33)] == ["uint16", "uint32", "uint64"]


def test_scores(spark):
    def two(f, a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]

    match = lambda c, r: two(lambda a, b: scoring.concept_matches(a, scoring.phrase(b)), c, r)
    assert match("IPv4 or IPv6", "uses ipv6") and match("H2O", "H 2 O") and not match("router", "routers")
    assert two(scoring.common_prefix_ratio, "a b x d", "a b c d") == 0.5
    assert abs(two(scoring.coverage, "a c", "a a b") - 1 / 3) < 1e-12
    assert one(spark, "a b c a b c", scoring.repetition) == 0.25
    assert two(scoring.token_f1, "a b", "a c") == 0.5
    assert two(scoring.coverage, "a", None) == 0.0


def test_weighted_perplexity(spark):
    import math

    x = spark.createDataFrame([(1.0, 10), (2.0, 30)], "loss double, n bigint")
    assert abs(scoring.token_weighted(x, "loss", "n").first().perplexity - math.exp(1.75)) < 1e-12
    assert scoring.token_weighted(x.where("n > 99"), "loss", "n").first().perplexity is None


def test_micro_and_macro(spark):
    x = spark.createDataFrame([("q", ["a"], "a", None), ("q", ["b", "c", "d"], "x", None)], "s string, expected_concepts array<string>, response string, expected_continuation string")
    r = scoring.summary(scoring.score(x), "s").first()
    assert (r.micro_recall, r.macro_recall, r.exact_queries) == (0.25, 0.5, 0)


def test_plateau(spark):
    means = [1.0, 0.995, 0.994, 0.993]
    w = spark.createDataFrame([("s", i, i * 10, m) for i, m in enumerate(means)], "s string, window bigint, start bigint, mean double")
    assert history.plateau(w, "s", 0.01, 3).first().plateau_start == 10


def test_masks_and_padding(spark):
    x = spark.createDataFrame([([1, 2, 3], [4, 5, 6, 7])], "p array<int>, r array<int>")
    m = x.select(instruct.masked(F.col("p"), F.col("r"), 5).alias("m")).first().m
    assert (m.input_ids, m.labels, m.attention_mask) == ([1, 2, 3, 4, 5], [-100, -100, -100, 4, 5], [1] * 5)
    e = spark.createDataFrame([(0, [1, 2], [1, 1], [1, 2]), (1, [1, 2, 3, 4], [1] * 4, [1, 2, 3, 4])], "i bigint, input_ids array<int>, attention_mask array<int>, labels array<int>")
    first = instruct.padded(e, "i", 2, 9).orderBy("i").first()
    assert (first.input_ids, first.attention_mask, first.labels) == ([1, 2, 9, 9], [1, 1, 0, 0], [1, 2, -100, -100])


def test_full_examples_keep_the_response(spark, tmp_path):
    from loam.queries import QUERIES

    words = lambda n: " ".join(f"w{i}" for i in range(n))
    pairs = [("a", words(60), words(5)), ("b", words(1023), words(5)), ("c", words(1024), words(5)), ("d", words(3), words(100))]
    spark.createDataFrame(pairs, "pair_id string, instruction string, response string").write.parquet(str(tmp_path / "evaluation.parquet"))
    assert {r.pair_id: r.n for r in QUERIES["sft_masks_full"](spark, str(tmp_path)).collect()} == {"a": 66, "b": 1024, "d": 104}
    assert [(r.pair_id, r.prompt_ids) for r in QUERIES["sft_refused"](spark, str(tmp_path)).collect()] == [("c", 1024)]
    assert sorted(r.i for r in QUERIES["padded_batches_full"](spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_line_questions(spark):
    body = "The interface must be set before use. " * 5
    texts = [
        f"Configuring the border\n{body}\n\nmore", None, "", f"About:\n{body}", f"Verifying the Path:\n\n\n{body}\nnext line.\n\nnot this", f"Overview of X\n{body}\nUnderstanding Y\nshort",
        f"Configuring A {'x' * 90}\n{body}", f"Configuring the list\n{body} ... and ...", f"Restrictions for {'a b ' * 3}\n{'word ' * 400}", f"How to Configure It\n{'x' * 300}",
        "About the limit\n" + "\n".join(["twenty characters .."] * 60),
    ]
    got = {}
    for r in instruct.line_pairs(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect():
        got.setdefault(r.id, []).append((r.pos, r.instruction, r.response))
    assert got[0] == [(0, "How do I configure the border on a Cisco device?", body.strip())]
    assert got[4] == [(0, "How do I verifying the Path?", f"{body}next line.")]
    assert [x[1] for x in got[5]] == ["Explain the following Cisco topic: Overview of X"]
    assert got[8][0][1] == "What are the restrictions for a b a b a b?" and len(got[8][0][2]) == 900
    assert set(got) == {0, 4, 5, 8, 10} and len(got[10][0][2]) == 900 and got[10][0][2].startswith("twenty characters .. twenty")


def test_context_length():
    assert prepare.context_length(None, 1024) == 1024
    for bad in ((None, None), (1, None), (4096, 1024)):
        try:
            prepare.context_length(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_balance():
    assert splits.balance(200, 500, 500) == (100, 100)
    assert splits.balance(200, 30, 500) == (30, 170)
    assert splits.balance(201, 500, 40) == (161, 40)
    try:
        splits.balance(10, 3, 3)
    except ValueError:
        return
    raise AssertionError


def test_ranks_within_groups(spark):
    rng = random.Random(9)
    data = [(rng.choice(["hot", "hot", "hot", "a", None, f"g{i % 40}"]), rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o int, i int")
    want, sizes = {}, {}
    for g, o, i in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = sizes.get(g, 0)
        sizes[g] = want[i] + 1
    got = ranked(df, ["g"], ["o", "i"], ["i"], "r", "n").collect()
    assert {x.i: x.r for x in got} == want and all(x.n == sizes[x.g] for x in got) and len(got) == 3000
    assert ranked(df.limit(0), ["g"], ["o"], ["i"]).count() == 0


def test_values_of_hot_groups(spark):
    data = [("h", i) for i in range(2500)] + [(f"g{i // 2}", 5000 + i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, k int")
    got = with_group_values(df, "g", "k", least=F.min("k"), n=F.count(F.lit(1))).collect()
    assert len(got) == 2800 and all((x.least, x.n) == ((0, 2500) if x.g == "h" else (5000 + 2 * int(x.g[1:]), 2)) for x in got)


def test_first_rows_and_k(spark, rows):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "g string, v int")
    assert rows(first_rows(df, ["g"], [F.col("v")])) == [("a", 1), ("b", 9)]
    assert rows(first_k(df, "g", ["v"], 2)) == [("a", 1, 1), ("a", 2, 2), ("b", 9, 1)]


def test_no_similar_pair_is_lost(spark):
    base = list(range(128))
    changed = lambda places, by: [v + by if i in places else v for i, v in enumerate(base)]
    spread = lambda n: {i * 128 // n for i in range(n)}
    rows = [(0, base)] + [(n, changed(spread(n), 1000 * n)) for n in (7, 8, 12, 19, 20)]
    signed = spark.createDataFrame(rows, "k bigint, signature array<bigint>")
    got = {(r.a, r.b): r.similarity for r in dedup.similar_pairs(signed, "k").collect()}
    want = {(a, b): sum(v == w for v, w in zip(x, y)) / 128 for a, x in rows for b, y in rows if a < b}
    assert got == {p: v for p, v in want.items() if v >= 0.85} and {(0, 8), (0, 12), (0, 19)} <= set(got) and (0, 20) not in got
    assert {(r.a, r.b) for r in dedup.similar_pairs(signed, "k", 1.0).collect()} == set()


def test_jaccard_pairs(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))]
        texts += [" ".join(w), " ".join(w[: rng.randrange(len(w)) + 1]), " ".join(w + w[:5]), " ".join("new" if rng.random() < 0.03 else v for v in w)]
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else set(w)
    sets = [runs(t.split()) for t in texts]
    want = {(i, j): len(x & y) / len(x | y) for j, y in enumerate(sets) for i, x in enumerate(sets[:j])}
    want = {p: v for p, v in want.items() if v >= 0.85}
    got = {(r.a, r.b): r.similarity for r in dedup.jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "k bigint, text string"), "k", "text").collect()}
    assert got == want and len(want) > 10


def test_overlap_of_short_and_long_bags(spark, monkeypatch):
    rng = random.Random(3)
    bags = [([rng.choice("abcdef") for _ in range(rng.randrange(0, 30))], [rng.choice("abcdxy") for _ in range(rng.randrange(0, 30))]) for _ in range(60)] + [(["a"] * 500, ["a"] * 300 + ["b"] * 9), ([], ["a"]), ([], [])]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(bags)], "k bigint, a array<string>, b array<string>")
    want = {i: sum((Counter(a) & Counter(b)).values()) for i, (a, b) in enumerate(bags)}
    for most in (scoring.PRODUCT, -1):
        monkeypatch.setattr(scoring, "PRODUCT", most)
        assert {r.k: r.n for r in df.select("k", scoring.overlap(F.col("a"), F.col("b")).alias("n")).collect()} == want


def test_lineage_names_kept_documents(spark):
    """Whatever the strategy, what a dropped document names is kept; a copy of a near duplicate names what that is near to."""
    base = [f"w{i}" for i in range(300)]
    near = [*base[:299], "edit"]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(near)), (4, " ".join(base)), (5, "other words " * 40), (6, None)]
    df = spark.createDataFrame(texts, "k bigint, t string")
    for strategy in ("exact", "near", "both"):
        cfg = prepare.PrepareConfig(strategy=strategy, gates=gates.GateConfig(language=None))
        got = {r.k: (r.reason, r.duplicate_of) for r in prepare.reasons(df, "k", "t", cfg).collect()}
        kept = {k for k, (reason, _) in got.items() if reason is None}
        assert len(got) == 6 and all(of in kept for _, of in got.values() if of is not None), strategy
        if strategy != "exact":
            assert got[2] == got[3] == ("near_duplicate", 1)
            assert got[4] == (("near_duplicate" if strategy == "near" else "exact_duplicate"), 1)
