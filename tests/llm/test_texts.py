"""Near duplicates, leaks, repetition, splits, pairs and subjects against brute force and at the edges."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.llm import leaks, neardups, pairs, repetition, splits, subjects, words

WORDS = [f"w{i}" for i in range(400)]


def test_word_hashes_follow_words(rng):
    texts = ["Ab cd, ab! x_1 é2", "", "--", "ab"]
    h, first, starts, stops = words.word_hashes([t.lower() for t in texts])
    assert np.diff(first).tolist() == [6, 0, 0, 1] and h[0] == h[2] == h[6]
    assert len(set(words.word_hashes([f"t{i} {i}t" for i in range(5000)])[0].tolist())) == 10_000


def test_readings():
    assert words.readings("auto-\n  nomous port-\nchannel") == ["autonomous portchannel", "auto-\n  nomous port-\nchannel"]
    assert words.readings("so­ft ﬁ Ａ") == ["soft fi a"] and words.readings(None) == []


def near_brute(texts, t=0.7):
    sets = {}
    for k, x in texts:
        w = re.findall(r"\w+", (x or "").lower())
        if len(w) >= 20:
            sets[k] = set(zip(w, w[1:], w[2:]))
    ks = sorted(sets)
    return sorted((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]))


def test_near_duplicates(spark, rng, rows):
    texts = [(0, None), (1, ""), (2, "too short")]
    for i in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(30, 120))]
        texts.append((10 * i + 10, " ".join(base)))
        edited = list(base)
        for _ in range(rng.randrange(0, 5)):
            edited[rng.randrange(len(edited))] = rng.choice(WORDS)
        texts.append((10 * i + 11, " ".join(edited)))
        cut = rng.randrange(10, 20)
        texts.append((10 * i + 12, " ".join(base[cut:] + base[:cut])))
        texts.append((10 * i + 13, " ".join(base).upper()))
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("same", F.lit(1)).withColumn("rep", F.lit("x"))
    links, members = neardups.near_duplicates(df, "id", "text")
    assert rows(neardups.expand(links, members, "id")) == sorted(near_brute(texts), key=repr)
    classes = {r.id: r for r in neardups.classes(links, members, "id").collect()}
    assert classes[10].class_id == 10 == classes[13].class_id and classes[10].links >= 1
    none, nobody = neardups.near_duplicates(df.limit(0), "id", "text")
    assert neardups.expand(none, nobody, "id").count() == 0


def test_a_notice_that_a_third_shares(spark, rng, rows):
    """Records that share a notice are no candidates through it, and no similar pair of them is lost."""
    notice = [f"n{i}" for i in range(40)]
    texts = []
    for i in range(1200):
        own = [f"u{rng.randrange(10**6)}" for _ in range(60)]
        texts.append((2 * i, " ".join(own + notice if i % 3 == 0 else own)))
        if i % 40 == 0:  # edited copies, with the notice in another place
            own[rng.randrange(60)] = "edit"
            texts.append((2 * i + 1, " ".join(notice + own if i % 3 == 0 else own)))
    df = spark.createDataFrame(texts, "id bigint, text string")
    made = neardups.sketch(df, "id", "text")
    assert made.select(F.explode("sketches").alias("s")).groupBy("s").count().agg(F.max("count")).first()[0] > 100
    few = neardups.candidates(made, "id", 0.7, hot=50)
    assert 30 <= few.count() < 200  # all pairs through the notice would be 80,000
    links, members = neardups.near_duplicates(df, "id", "text", hot=50)
    assert rows(neardups.expand(links, members, "id")) == sorted(near_brute(texts), key=repr)
    again, same = neardups.near_duplicates(df, "id", "text")
    assert rows(neardups.expand(again, same, "id")) == rows(neardups.expand(links, members, "id"))


def test_sets_agree_where_one_side_repeats(spark, rng, rows):
    texts = []
    for k in range(20):
        base, notice = [f"b{rng.randrange(10**6)}" for _ in range(300)], [f"{k}n{i}" for i in range(30)]
        texts += [(2 * k, " ".join(base + notice)), (2 * k + 1, " ".join(base + notice * 60))]
    links, members = neardups.near_duplicates(spark.createDataFrame(texts, "id bigint, text string"), "id", "text", describe=False)
    assert rows(neardups.expand(links, members, "id")) == sorted(near_brute(texts), key=repr) and len(near_brute(texts)) == 20


def test_banded_distance():
    a, b = np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.uint64)
    c = np.delete(a, [3, 20])
    d = a.copy()
    d[[5, 6]] = 999
    got = neardups.banded_distance([a, a, a, c], [b, c, d, a], [0, 0, 0, 0])
    assert got.tolist() == [0, 2, 2, 2]


def test_leaks(spark, rng):
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    w = item.split()
    docs = [
        (1, f"before {item} after"), (2, " ".join(w[5:15])), (3, " ".join(w[5:14])), (4, "> " + " ".join(w[:6]) + "\n> " + " ".join(w[6:12]).upper()),
        (5, None), (6, ""), (7, f"{' '.join(w[:4])} {w[4][:1]}-\n{w[4][1:]} {' '.join(w[5:11])}"), (8, " ".join(w[:5] + ["other"] + w[5:9])), (9, item),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit(1)).withColumn("pos", F.lit(2))
    i = spark.createDataFrame([("a", item), ("a", item), ("n", None), ("e", ""), ("s", "short one")], "item_id string, item string").withColumn("j", F.lit(1))
    exact, near = leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item")
    assert sorted({r.doc_id for r in exact.collect()}) == [1, 2, 4, 7, 9]
    report = {r.doc_id: r for r in leaks.leak_report(exact, i, "doc_id", "item_id", "item").collect()}
    assert (report[1].longest, report[1].covered, report[1].words) == (30, 30, 30) and report[2].longest == 10
    for x, y in ((d.limit(0), i), (d, i.limit(0))):
        assert leaks.find_leaks(x, "doc_id", "text", y, "item_id", "item")[0].count() == 0


def test_near_matches_take_the_best_cluster(spark):
    w = [f"w{i}" for i in range(30)]
    item, other = " ".join(w), " ".join(f"x{i}" for i in range(40))
    part = lambda a, b: " ".join(w[a:b])
    docs = [
        (1, item), (2, f"{item} {other} {item}"), (3, f"{part(0, 10)} {other} {part(0, 4)} {other} {part(0, 4)}"), (4, f"{part(3, 8)} y y y {part(8, 30)}"),
        (5, f"{part(0, 4)} {other} {part(20, 24)}"), (6, f"{part(10, 14)} a {part(15, 19)} {other}"), (7, f"{part(12, 16)} {part(5, 9)}"), (8, f"z {part(0, 4)} {part(5, 15)}"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([("a", item)], "item_id string, item string")
    # by hand: the offsets of the rarest runs of the item in each document
    near = {r.doc_id: (r.n_terms, r.spread) for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item")[1].collect()}
    df = {j: sum(t.split()[p : p + 4] == w[j : j + 4] for _, t in docs for p in range(len(t.split()))) for j in range(27)}
    anchors = {min(range(a, min(a + 7, 27)), key=lambda j: (df[j], j)) for a in range(27)}
    want = {}
    for key, t in docs:
        places = [(p - j, j) for j in anchors for p in range(len(t.split())) if t.split()[p : p + 4] == w[j : j + 4]]
        spans = [(len({j for v, j in places if a <= v <= b}), a - b) for a, _ in places for b, _ in places if 0 <= b - a <= 8]
        n, s = max(spans, default=(0, 0))
        if n >= 2:
            want[key] = (n, -s)
    assert near == want and near[2] == near[1] and {1, 2, 3, 4} <= set(near)


def test_near_matches_at_the_start_of_a_document(spark):
    w = [f"w{i}" for i in range(16)]
    d = spark.createDataFrame([(1, " ".join(["a", *w[:4], *w[6:10]]))], "doc_id bigint, text string")  # offsets 1 and -1
    i = spark.createDataFrame([("a", " ".join(w))], "item_id string, item string")
    assert [tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item")[1].collect()] == [(1, "a", 2, 2)]


def repeats(text):
    w = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen, mark = set(), [False] * len(w)
    for i in range(len(w) - 3):
        if (g := tuple(w[i : i + 4])) in seen:
            mark[i : i + 4] = [True] * 4
        seen.add(g)
    return len(w), sum(mark)


def test_repetition(spark, rng):
    texts = [None, "", "1 2 3", "a b c d " * 9, "Sentence one is here. " * 2, "x " * 400]
    for _ in range(60):
        w = [rng.choice(WORDS[:50]).translate({ord(c): "abcdefghij"[int(c)] for c in "0123456789"}) for _ in range(rng.randrange(5, 60))]
        texts.append(" ".join(w + w[: rng.randrange(len(w))]))
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "id bigint, text string").withColumn("pattern", F.lit("p"))
    scored = repetition.score(df, "id", "text")[0]
    assert {r.id: (r.n_words, r.n_repeated) for r in scored.collect()} == {i: repeats(x) for i, x in enumerate(texts)}
    # the posterior alone decides: what is flagged is what reaches the cut, and another cut gives other rows
    assert {r.id for r in repetition.repetitive(df, "id", "text").collect()} == {r.id for r in scored.collect() if r.p_repetitive >= repetition.CUT}
    assert repetition.score(df, "id", "text", cut=0.0)[0].where("flagged").count() > scored.where("flagged").count() > 0
    assert not {0, 1, 2} & {r.id for r in repetition.repetitive(df, "id", "text").collect()} and {3, 5} <= {r.id for r in repetition.repetitive(df, "id", "text").collect()}
    assert repetition.repetitive(df.limit(0), "id", "text").count() == 0


def test_one_sided_corpora(spark):
    df = spark.createDataFrame([(i, "over and over again " * (5 + i % 7)) for i in range(40)] + [(90, None), (91, ""), (92, "one two three")], "id bigint, text string")
    assert {r.id for r in repetition.repetitive(df, "id", "text").collect()} == set(range(40))
    assert repetition.repetitive(df.where("id >= 90"), "id", "text").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_posterior_against_the_definition(spark, sf):
    """Precision and recall of the posterior against the counted share, which it never sees."""
    scored = repetition.score(spark.read.parquet(f"/root/testdata/{sf}/model_responses.parquet"), "response_id", "response")[0]
    exact = (F.col("n_words") >= repetition.LEAST) & (F.col("n_repeated") >= repetition.SHARE * F.col("n_words"))
    both, flagged, true = scored.agg(F.count_if(F.col("flagged") & exact), F.count_if("flagged"), F.count_if(exact)).first()
    assert true and both >= 0.99 * flagged and both >= 0.99 * true


def test_repeated_words_of_a_batch(rng):
    texts = [" ".join(rng.choice("abc") * 3 for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    h, first, _, _ = words.word_hashes(texts, digits=False)
    assert repetition.repeated_words(h, first).tolist() == [repeats(x)[1] for x in texts]


def test_em_finds_good_rules():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    counts: dict[str, int] = {}
    for t in truth:
        p = "".join("2" if rng.random() < 0.2 else str(int(t) if rng.random() < q else int(not t)) for q in (0.95, 0.9, 0.85, 0.9, 0.6, 0.8))
        counts[p] = counts.get(p, 0) + 1
    model = repetition.estimate(counts)
    assert abs(model["prior"] - 0.2) < 0.04 and model["right"]["run_share"][1] > model["right"]["same_word_share"][1]


def test_documents_named():
    same = ["Xal Border Guide, Release 1.4", "The Xal  Border Guide, Rel. 1.4", "xal_border_guide_v1.4", "/srv/x/xal-border-guide-1-4.pdf", "XAL BORDER GUIDE (RELEASE 1.4), Chapter 3", "a\\b\\xal-border-guide-1-4.pdf"]
    assert {tuple(splits.documents_named(x)) for x in same} == {("title:xal border guide|1.4",)}
    assert {tuple(splits.documents_named(x)) for x in ["RFC 0123", "rfc_123", "[RFC123]", "Request for Comments: 123", "RFC123.txt", "RFC 123, Section 4.2"]} == {("rfc:123",)}
    assert splits.documents_named("RFC 1; Xal Guide 2.0") == ["rfc:1", "title:xal guide|2.0"]
    assert all(splits.documents_named(x) == [] for x in (None, "", " ", "n/a", "unknown", "-", "tbd"))
    assert splits.documents_named("RFC 124") != splits.documents_named("RFC 125")


def test_splits_keep_groups(spark):
    rows = [(f"q{i:03d}", f"RFC {i // 4}" if i % 9 else None, f"x/rfc{i // 4}.txt" if i % 5 else None) for i in range(400)] + [("q900", "RFC 1 and RFC 2", None), ("q900", "RFC 1 and RFC 2", None)]
    df = spark.createDataFrame(rows, "id string, source_document string, source_file string").withColumn("entity", F.lit(0)).withColumn("component", F.lit(0))
    grouped = splits.groups(df, "id", ["source_document", "source_file"])
    comp = {r.id: r.component for r in grouped.collect()}
    assert comp["q004"] == comp["q009"] == comp["q900"] == "q004" and comp["q000"] != comp["q004"] and len(comp) == 401
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, proportion double")
    got = splits.assign(grouped, "id", targets).collect()
    side = {}
    for r in got:
        side.setdefault(r.component, set()).add(r.split_name)
    assert all(len(s) == 1 for s in side.values()) and None not in set().union(*side.values())
    share = sum(r.split_name == "train" for r in got) / len(got)
    assert 0.7 < share < 0.9
    assert splits.assign(splits.groups(df.limit(0), "id", ["source_document"]), "id", targets).count() == 0
    # a component that holds most rows, and rows that come later, move nobody
    more = grouped.unionByName(spark.range(2000).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("id"), F.lit("z0").alias("component")))
    later = {r.component: r.split_name for r in splits.assign(more, "id", targets).collect()}
    assert all(later[r.component] == r.split_name for r in got) and later["z0"] in ("train", "validation", "test")
    assert {r.split_name for r in splits.assign(grouped, "id", targets.where("split_name = 'test'")).collect()} == {"test"}
    assert {r.split_name for r in splits.assign(grouped, "id", targets.limit(0)).collect()} == {None}


SOUND = [
    (f"How does the {a} {v} the {b} in X{i}?", f"The {a} of X{i} will {v} the {b} after {i} seconds. When the {b} fails, each {a} must {v} another {b} of Z{i} within {i} packets.")
    for i, (a, v, b) in enumerate([(x, y, z) for x in ("router", "switch", "volume", "sensor") for y in ("limit", "mirror", "update") for z in ("table", "record", "prefix", "frame", "queue")] * 4)
]
GERMAN = [(f"Wie prüft die Anlage die Tabelle X{i}?", f"Die Anlage von X{i} prüft zuerst die Tabelle, und das Gerät begrenzt {i} Sekunden. Wenn der Dienst die Tabelle ersetzt, meldet die Anlage das Ergebnis.") for i in range(60)]


def test_broken_pairs():
    model = pairs.fit([*SOUND, *GERMAN])
    assert min(model["held_out"].values()) > 0.9
    ask, say = SOUND[5]
    judge = lambda r, q=ask: pairs.defects(q, r, model)
    for nothing in (None, "", " \n", ".", "...", "N/A", "<p></p>", "[]", "null", "​", '""'):
        assert judge(nothing) == ["empty"]
    assert judge(say) == [] and judge(say.rstrip(".").split(". ")[0]) == [] and judge("Yes.") == []
    assert judge("I'm sorry, but I cannot help with that.") == ["refusal"]
    assert judge(ask.upper()) == ["copy"] and judge(f"{ask} {say}") == []
    assert judge(GERMAN[3][1]) == ["language"]
    assert "truncated" in judge("The switch of X9 will mirror the table after 9 seconds. When the table fails, each")
    assert judge(say, None) == [] and judge(ask, "") == []


def test_nothing_to_go_by_is_no_defect():
    for sample in ([*SOUND, *GERMAN], SOUND[:12], []):
        model = pairs.fit(sample)
        for say in ("7", "0x3f", "Yes", "No.", "UDP port 53", "Wolnax", "X", "1.5"):
            for ask in (None, "", SOUND[0][0], GERMAN[0][0]):
                assert not {"refusal", "copy", "language"} & set(pairs.defects(ask, say, model)), (say, ask)
    none = pairs.features("", "0", frozenset(), pairs.Profiles([]))
    assert none["language"] == {} and set(none["copy"]) == {"bias", "no words"}


def test_languages_from_ngrams():
    profiles = pairs.Profiles([f"{i} {r}" for i, r in [*SOUND, *GERMAN]])
    assert profiles.language("der prüfende Dienst begrenzt danach alle Geräte") == "de" and profiles.language("the switch limits every table") == "en"
    assert profiles.language("Après quoi le service vérifie la table") == "fr" and profiles.language("El servicio verifica la tabla según lo previsto") == "es"
    assert profiles.language("X9 ABC 17") == "" and profiles.language("```\nset unit port\n```") == ""
    assert profiles.expected("Say it in French: the switch limits every table.") == {"en", "fr"}


def test_counts_hold_over_samples():
    """The labels' counts over the whole table agree within 2 percent (or 2 rows), whatever sample the models are fitted on."""
    table = pd.read_parquet("/root/testdata/sf0.1/evaluation.parquet").drop_duplicates("pair_id")
    both = list(zip(table.instruction, table.response))
    counts = []
    for n in (300, 1000, 2000, 3000):
        own = table.sample(min(n, len(table)), random_state=5)
        model = pairs.fit(list(zip(own.instruction, own.response)))
        counts.append(Counter(d for i, r in both for d in pairs.defects(i, r, model)))
    for label in ("empty", *pairs.LABELS):
        most = counts[-1][label]
        assert all(abs(c[label] - most) <= max(2, 0.02 * most) for c in counts), (label, counts)


def test_broken_pairs_table(spark):
    rows = [(f"p{i}", q, r) for i, (q, r) in enumerate([*SOUND, *GERMAN])] + [("e", None, None), ("e", None, None), ("c", SOUND[1][0], SOUND[1][0])]
    df = spark.createDataFrame(rows, "pair_id string, instruction string, response string").withColumn("defect", F.lit(1))
    got = {(r.pair_id, r.defect) for r in pairs.broken_pairs(df, "pair_id", "instruction", "response").collect()}
    assert got == {("e", "empty"), ("c", "copy")}
    assert pairs.broken_pairs(df.limit(0), "pair_id", "instruction", "response").count() == 0


EXAMPLES = [(s, f"The {a} must join the {b} now. Each {b} limits one {a} today. Another {a} follows.") for s, (a, b) in {"routing": ("prefix", "router"), "law": ("tribunal", "contract"), "sport": ("referee", "stadium")}.items()] * 2


def test_subjects(spark):
    routing = "The router limits a prefix today. "
    plain = "The document names a record today. "
    docs = [(1, routing * 3 + plain * 3), (2, plain * 20 + "The tribunal limits a value today. "), (3, None), (4, ""), (5, "prefix"), (6, routing + "The refe­ree names a sta-\ndium today."), (7, "```\nset router prefix now here\n```\n" + plain * 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("subject", F.lit("x")).withColumn("hits", F.lit(1))
    ex = spark.createDataFrame(EXAMPLES, "subject string, text string")
    got = sorted((r.doc_id, r.subject) for r in subjects.document_subjects(df, "doc_id", "text", ex).collect())
    assert got == [(1, "routing"), (6, "routing"), (6, "sport")]
    assert subjects.document_subjects(df.limit(0), "doc_id", "text", ex).count() == 0
    assert subjects.document_subjects(df, "doc_id", "text", ex.limit(0)).count() == 0


def test_sentences():
    assert subjects.sentences("Ein pareâ€“feu wird heute geprÃ¼ft. Zu kurz.") == ["ein pare-feu wird heute geprüft"]
    assert subjects.sentences(None) == [] and subjects.sentences("no shutdown set unit range") == []


def test_examples_of_every_subject(spark):
    """Beyond the bound every subject keeps its share of examples, whatever its name."""
    rows = [(f"s{i % 4}" if i % 3 else "a", f"text {i}") for i in range(6000)] + [("z", "only one"), (None, "x"), ("a", None), ("a", "")]
    found = Counter(s for s, _ in subjects.sample_of(spark.createDataFrame(rows, "subject string, text string")))
    assert set(found) == {"a", "s0", "s1", "s2", "s3", "z"} and found["z"] == 1 and sum(found.values()) <= subjects.EXAMPLES
    assert min(v for k, v in found.items() if k != "z") == subjects.EXAMPLES // 6


def test_too_many_terms_are_an_error(monkeypatch):
    monkeypatch.setattr(subjects, "TERMS", 10)
    with pytest.raises(ValueError, match="terms"):
        subjects.lexicon(EXAMPLES)


def test_an_open_code_block_ends_at_a_blank_line():
    assert subjects.sentences("```\nset a b c d.\n\nThe switch forwards every frame.") == ["the switch forwards every frame"]
    assert subjects.sentences("```\nx y z w.\n\nset a b c d.\n```\n\nThe switch forwards every frame.") == ["the switch forwards every frame"]
