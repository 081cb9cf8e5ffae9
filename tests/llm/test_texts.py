"""Languages, personal values, reading levels, packing and mixing."""

import functools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import language as L, privacy as P, readability as R
from lodestrata.llm.mixing import mix_report, mix_sources, plan_mix, route
from lodestrata.llm.packing import fill_report, pack, pack_documents
from lodestrata.llm.prose import sentences
from lodestrata.llm.tokens import VOCABULARY, encoder, pieces, token_counts
from lodestrata.session import table

D = "/root/testdata/sf0.01"

# ------------------------------------------------------------------ prose


def test_sentences():
    text = "# Head\r\n\r\nOne here. Two [link](http://x.y/z) there!\n```sh\ncode here. More\n```\n| a | b |\n|---|---|\n**Bold**\n- Item three\n> Quote four.\n[![b](x)](y)\nTitle\n-----\n这是。那是！\nend `x` a@b.cd"
    assert sentences(text) == ["One here.", "Two link there!", "Item three", "Quote four.", "这是。", "那是！", "end     "[:3]]
    assert sentences("") == [] and sentences("```\nopen fence. text") == [] and sentences("a | b / c") == ["a", "b", "c"]


# ------------------------------------------------------------------ languages


@pytest.fixture(scope="module")
def model(spark):
    return L.train(table(spark, D, "documents"), "doc_id", "text", "lang")


def found(spark, model, texts, lang=None):
    df = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "id long, text string, lang string")
    return L.identify(df, "text", model, ["id", "lang"])


CASES = {
    "en": "The main program copies the whole project and then it stops.", "es": "La herramienta guarda todos los mensajes y también muestra las tablas viejas.", "pt": "O servidor não envia os arquivos de entrada, mas guarda as cópias.",
    "fr": "Le serveur enregistre les longs textes et affiche aussi les vieux tableaux.", "de": "Der Server verarbeitet die alten Tabellen und zeigt auch die Karten der Stadt.", "it": "Il motore di ricerca salva tutti i messaggi e poi ordina le vecchie tabelle.",
    "ru": "Новый инструмент собирает карты района и затем копирует старые таблицы.", "zh": "这个工具会检查街区地图，可以在终端里完成。",
}


def test_single_and_mixed(spark, model):
    assert model.langs == sorted(CASES)
    got = {r.id: [x.lang for x in r.languages] for r in found(spark, model, list(CASES.values())).collect()}
    assert got == {i: [k] for i, k in enumerate(CASES)}
    mixed = found(spark, model, [CASES["de"] + " " + CASES["de"] + "\n\n" + CASES["ru"]]).first().languages
    assert [x.lang for x in mixed] == ["de", "ru"] and abs(sum(x.confidence for x in mixed) - 1) < 1e-4


@pytest.mark.parametrize("text", [None, "", "x", "# Title only\n\n```\nint main;\n```", "Ruben Maria Lopez, 12 Old Mill Road, Kukeville", "🐦🐦", "code | tea | code", "\n" * 1000])
def test_no_language(spark, model, text):
    assert found(spark, model, [text]).first().languages == []


def test_long_text_is_read_whole(spark, model):
    r = found(spark, model, [CASES["en"] + " " + (CASES["en"] + " ") * 3000 + CASES["zh"]]).first()
    assert {x.lang for x in r.languages} == {"en", "zh"}


def test_labels(spark, model):
    said = [("en", []), ("EN-us", []), (None, ["en"]), ("", ["en"]), ("und", ["en"]), ("es", ["en"]), ("klingon", ["en"])]
    for lang, want in said:
        rows = L.wrong_labels(found(spark, model, [CASES["en"], ""], lang), "id", "lang").collect()
        assert [r.lang for r in rows] == want, lang
    assert L.wrong_labels(found(spark, model, [], "en"), "id", "lang").count() == 0


def test_held_out_accuracy(spark, model):
    """Labels are mostly right, so agreement on unmixed texts is a lower bound of accuracy."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    one = L.identify(docs, "text", model, ["doc_id", "lang"]).where("size(languages) = 1").withColumn("said", L.declared(F.col("lang"))).where("said is not null")
    assert one.where(F.col("said") == F.col("languages")[0]["lang"]).count() >= 0.9 * one.count()


def test_segments(spark, model):
    text = CASES["en"] + " Yes. " + CASES["en"] + "\n" + CASES["fr"] + "\n" + CASES["en"]
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Xq 12")], "id long, text string")
    rows = [(r.id, r.segment_no, r.lang, r.sentences) for r in L.segments(df, "id", "text", model).orderBy("id", "segment_no").collect()]
    assert rows == [(1, 0, "en", 3), (1, 1, "fr", 1), (1, 2, "en", 1), (4, 0, "und", 1)]


def test_declared(spark):
    df = spark.createDataFrame([(x,) for x in ("pt-BR", "fr_FR", "spa", "Chinese", " DE ", "unknown", None, "xx-yy", "nl")], "l string")
    assert [r[0] for r in df.select(L.declared(F.col("l"))).collect()] == ["pt", "fr", "es", "zh", "de", None, None, "xx-yy", "nl"]


def test_fit_without_labels(spark):
    empty = L.fit([])
    assert found(spark, empty, ["some text is here."]).first().languages == []


# ------------------------------------------------------------------ personal values

TEXTS = [
    "Questions go to Rafik Klebo, who can be reached at rafik.klebo@mail.example.",
    "Ask Rafik Tumas <rafik+x@mail.example> or call +44 7700 900123.",
    "Maintained by Rafik Sono.", "Maintained by Petra Lu.", "Maintained by Petra Mi <petra@a.example>", "Maintained by Noor Ba.", "Petra Vo <hello-petra@a.example>",
    "Noor Ta <noor@b.example>", "Noor Ze, 12 Old Mill Road, Kuke", "Write to noor_ka (at) b (dot) example, Noor Ka.",
] + [f"The {w} Tool copies Copper Harbor files of version 4.{i}." for i, w in enumerate(["Big", "Small", "Old", "New"] * 10)]


@pytest.fixture(scope="module")
def learned(spark):
    return learning(spark, TEXTS)


def learning(spark, texts):
    return P.learn(P.candidates(spark.createDataFrame([(t,) for t in texts], "t string"), "t"))


@functools.lru_cache(maxsize=None)
def known(learned):
    return {r.term for r in learned.terms.collect()}, {r.context for r in learned.contexts.collect()}


def values(learned, text):
    return [(k, text[s:e]) for s, e, k in P.find(text, *known(learned))]


@pytest.mark.parametrize("text, want", [
    ("mail a.b+c@x-y.example.org now", [("email", "a.b+c@x-y.example.org")]), ("UP@CASE.EXAMPLE", [("email", "UP@CASE.EXAMPLE")]), ("x @ y.test", [("email", "x @ y.test")]), ("jo [at] y.test", [("email", "jo [at] y.test")]),
    ("jo(at)y(dot)test", [("email", "jo(at)y(dot)test")]), ("jo AT y DOT test", [("email", "jo AT y DOT test")]), ("look at this dot test", []), ("git clone git@h.example:a/b.git", []), ("ssh deploy@203.0.113.9 './x'", []), ("npm i @scope/pkg@1.2.3", []),
    ("call +1 (648) 555-0116!", [("phone", "+1 (648) 555-0116")]), ("(020) 7946 0045", [("phone", "(020) 7946 0045")]), ("01 99 00 75 59", [("phone", "01 99 00 75 59")]), ("713-555-0129", [("phone", "713-555-0129")]), ("+33.6.39.98.07.42", [("phone", "+33.6.39.98.07.42")]),
    ("0049-171-39200-95", [("phone", "0049-171-39200-95")]), ("key 0000-0000-0000", []), ("ticket 394-28412 of 2023-12-20", []), ("kernel 5.36.0-10", []), ("ISO record 8429-7:2015, checksum 63442187", []), ("http://192.0.2.82:8080/k?id=271877186", []),
    ("SSN 959-28-8080", [("id_number", "959-28-8080")]), ("my NINO QQ 39 48 00 D on", [("id_number", "QQ 39 48 00 D")]), ("tax id 000 100 636 16 on", [("id_number", "000 100 636 16")]), ("passport no. ZX1060518 and", [("id_number", "ZX1060518")]), ("ID card no. ZX-931854-3", [("id_number", "ZX-931854-3")]),
    ("at Flat 4, 32 Heron Rd, Mohe", [("street_address", "Flat 4, 32 Heron Rd, Mohe")]), ("in C/ Herreros 139a, 97147 Tobu.", [("street_address", "C/ Herreros 139a, 97147 Tobu")]), ("hier: Hinterer Graben 15", [("street_address", "Hinterer Graben 15")]),
    ("Gerberstr. 118", [("street_address", "Gerberstr. 118")]), ("au 15b chemin de la Source.", [("street_address", "15b chemin de la Source")]), ("na Travessa da Fonte, 16", [("street_address", "Travessa da Fonte, 16")]), ("", []),
    ("Maintained by Zed Unseen.", [("person_name", "Zed Unseen")]), ("Petra Foo wrote it.", [("person_name", "Petra Foo")]), ("Thanks to Foo, Petra.", [("person_name", "Foo, Petra")]), ("Copper Harbor is a tool.", []), ("X. Quux <q@a.example>", [("person_name", "X. Quux"), ("email", "q@a.example")]),
    ("```\nPetra = Maintained\n# Maintained by Petra Foo\n```", [("person_name", "Petra Foo")]),
])
def test_values(learned, text, want):
    assert values(learned, text) == want


def test_personal_values_and_placeholders(spark, learned):
    df = spark.createDataFrame([(1, "名 Petra Foo, 12 Old Mill Road; x@y.test", "k"), (2, None, "k"), (3, "", "k"), (4, "plain", "k")], "id long, t string, kind string")
    rows = P.personal_values(df.select("id", "t"), ["id"], "t", learned).orderBy("start_pos").collect()
    assert [(r.id, r.kind, r.start_pos) for r in rows] == [(1, "person_name", 3), (1, "street_address", 14), (1, "email", 32)]
    out = {r.id: (r.t, r.replaced) for r in P.sanitize(df, ["id"], "t", learned).collect()}
    assert out == {1: ("名 [PERSON_NAME], [STREET_ADDRESS]; [EMAIL]", 3), 2: (None, 0), 3: ("", 0), 4: ("plain", 0)}


def test_learning_from_nothing(spark):
    none = learning(spark, [None, ""])
    assert values(none, "Petra Foo and x@y.test") == [("email", "x@y.test")]
    assert P.personal_values(spark.createDataFrame([], "id long, t string"), ["id"], "t", none).count() == 0


def test_a_copied_text_does_not_hide_other_names(spark):
    """A third of the rows are copies of one text with a name and its address; others' names are beside theirs in some texts only."""
    copied = "Written by Rafik Klebo <rafik.klebo@mail.example>."
    rows = [copied] * 60
    for i, name in enumerate(["Petra", "Noor", "Tomas", "Ines"] * 5):
        rows += [f"Ask {name} <{name.lower()}{i}@a.example> first.", f"Thanks go to {name} for part {i}.", f"Reviewed with {name} in week {i}.", f"Sent along by {name} as draft {i}.", f"The Build of Monday {i} is good.", f"The Release of Friday {i} is good."]
    found = learning(spark, rows)
    assert values(found, "We met Petra and later Ines at noon.") == [("person_name", "Petra"), ("person_name", "Ines")]
    assert values(found, "It says Rafik here.") == [("person_name", "Rafik")]
    assert values(found, "The Build of Monday is good.") == []


def test_long_text(learned):
    text = "word " * 200_000 + "Maintained by Petra Foo."
    assert values(learned, text) == [("person_name", "Petra Foo")]


# ------------------------------------------------------------------ reading levels


@pytest.mark.parametrize("word, n", [("the", 1), ("table", 2), ("stopped", 1), ("started", 2), ("reading", 2), ("generation", 4), ("make", 1), ("makes", 1), ("classes", 2), ("beautiful", 3), ("x", 1), ("", 1)])
def test_syllables(word, n):
    assert R.syllables(word) == n


def test_samples_leave_one_out(spark):
    rows = [tuple(r) for r in table(spark, D, "reading_samples").select("text", "reading_level").collect()]
    known = R.Counts()
    graded = [(R.level_of(R._prose_counts(t, known)), lv) for t, lv in rows]
    right = 0
    for i, (g, lv) in enumerate(graded):
        cuts = R.cut_points(graded[:i] + graded[i + 1 :])
        right += max(c for c in cuts if c[0] <= g)[1] == lv
    assert right >= 0.95 * len(rows)


def test_levels(spark, model):
    cuts = R.fit_levels(table(spark, D, "reading_samples"), "text", "reading_level")
    easy, hard = "You see the map. Is it on? The bot is new. Run it. You see the list now. The map goes on.", table(spark, D, "reading_samples").where("reading_level = 5").first().text
    texts = [easy, hard, hard + "\n\nIs it on?\n\n```\ncode code. code.\n```\n# head", None, "", "```\nonly code\n```", CASES["de"], easy + " " + CASES["de"]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, grade int")
    got = {r.id: r.reading_level for r in R.reading_levels(df, "id", "text", cuts, model).collect()}
    assert got == {0: 1, 1: 5, 2: 5}
    plain = {r.id for r in R.reading_levels(df, "id", "text", cuts).collect()}
    assert plain == {0, 1, 2, 6, 7}
    assert R.reading_levels(df.where("false"), "id", "text", cuts, model).count() == 0


def test_cut_points_of_one_level():
    assert R.cut_points([(1.0, 3)]) == [(float("-inf"), 3)] and R.cut_points([]) == []


# ------------------------------------------------------------------ tokens and packing


def test_token_counts(spark):
    enc = encoder(open(VOCABULARY, "rb").read())
    texts = ["", None, "hello world", "名前 🐦", "<|endoftext|>", "x" * 50_000, "a b " * 30_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: r.n_tokens for r in token_counts(df, ["id"], "t").collect()}
    for i, t in enumerate(texts):
        if t and len(t) <= 20_000:
            assert got[i] == len(enc.encode_ordinary(t)) and enc.decode(enc.encode_ordinary(t)) == t
    assert got[0] == got[1] == 0 and abs(got[6] - len(enc.encode_ordinary(texts[6]))) <= 12
    assert all("".join(pieces(t)) == t for t in texts if t is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.integers(100, 300))
def test_pack(sizes, capacity):
    box = pack(np.array(sizes, np.int64), capacity)
    fill = Counter()
    for s, b in zip(sizes, box.tolist()):
        fill[b] += s
    assert all(v <= capacity for v in fill.values())
    assert len(fill) <= 2 * (sum(sizes) // capacity + 1) + 1


def test_pack_fills_and_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 5000)
    box = pack(sizes, 2048)
    assert sizes.sum() / ((box.max() + 1) * 2048) > 0.99
    cost = np.bincount(box, sizes + sizes * sizes / 2048)
    assert cost.std() / cost.mean() < 0.1


def test_pack_documents(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 90, 100, 101, 250, 1000])) for i in range(300)] + [(None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    boxes = spark.createDataFrame([("s", 100), ("l", 900), (None, 5), ("zero", 0), ("s", 100)], "container_name string, capacity_tokens long")
    packed = pack_documents(docs, "doc_id", boxes, shard_items=50)
    got = packed.collect()
    caps, per, parts = {"s": 100, "l": 900}, Counter(), defaultdict(list)
    for r in got:
        per[r.container_name, r.container_id] += r.n_tokens
        parts[r.container_name, r.doc_id].append((r.part_no, r.first_token, r.n_tokens))
    assert all(v <= caps[k[0]] for k, v in per.items()) and {k[0] for k in per} == set(caps)
    for name, cap in caps.items():
        for i, n in rows[:-1]:
            p = sorted(parts[name, i])
            assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p))) and len(p) == -(-n // cap)
            assert [x[1] for x in p] == [cap * k for k in range(len(p))]
    report = {r.container_name: r for r in fill_report(packed, boxes.where("capacity_tokens > 0 and container_name is not null")).collect()}
    assert report["s"].fullest <= 100 and report["l"].tokens == sum(n for _, n in rows[:-1])
    assert pack_documents(docs.where("false"), "doc_id", boxes).count() == 0 and pack_documents(docs, "doc_id", boxes.where("false")).count() == 0


# ------------------------------------------------------------------ mixing


def test_route_is_cheapest():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    total, routes = route(patterns, {"a": 120, "b": 30}, {"a": 2, "b": 2})
    assert total == 150 and sum(routes.values()) == 150
    by_source = Counter()
    for (_, _, s), n in routes.items():
        by_source[s] += n
    assert by_source == {"a": 120, "b": 30} and all(level == 1 for _, level, _ in routes)


def test_plan_is_largest():
    size, routes = plan_mix({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    assert size in (60, 61) and max(level for (_, level, s) in routes if s == "b") == 3
    assert plan_mix({("a",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1})[0] in (0, 1)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, f"t{i}", "big" if i % 10 else "tiny", rng.randrange(1, 60)) for i in range(2000)]
    rows += [(5000 + i, f"t{i}", "mid", rows[i][3]) for i in range(0, 2000, 4)] + [(9000, "n", None, 10), (9001, "z", "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.2, 2), ("m", "tiny", 0.3, 3), ("one", "tiny", 7.0, 1), ("none", "absent", 1.0, 1), (None, "big", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mix_sources(docs, "doc_id", "text", "source", targets)
    got = mixed.collect()
    held = defaultdict(set)
    for i, t, s, _ in rows:
        held[t].add(s)
    texts = {i: t for i, t, _, _ in rows}
    used = Counter()
    for r in got:
        assert r.source in held[texts[r.doc_id]]
        used[r.mix_name, r.doc_id] += r.copies
    assert max(v for (m, _), v in used.items() if m == "m") <= 3 and len({(r.mix_name, r.doc_id, r.source) for r in got}) == len(got)
    report = {(r.mix_name, r.source): r for r in mix_report(mixed, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.2), ("tiny", 0.3)):
        assert abs(report["m", s].actual_share - share) < 0.02
    assert report["one", "tiny"].actual_share == 1 and report["none", "absent"].tokens == 0 and ("none", "absent") not in {(r.mix_name, r.source) for r in got}
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs, "doc_id", "text", "source", targets).collect()))
    assert mix_sources(docs.where("false"), "doc_id", "text", "source", targets).count() == 0 and mix_sources(docs, "doc_id", "text", "source", targets.where("false")).count() == 0
