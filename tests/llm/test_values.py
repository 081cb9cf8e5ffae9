"""Canonical values and variant names."""

import random

import pytest

from lodestrata.llm.canonical import edits, fold, forms, match_canonical, phrases, place_entries
from lodestrata.llm.names import link_names, nickname, parse, short_forms, variant_pairs

PLACES = [
    (1, "Šenuhaven", "Kaguthvior", "KTZ", [], 5), (2, "Fort Dolath", "Kaguthvior", "KTZ", ["Dragrovik"], 9), (3, "Port Dolath", "Mikludraia", "MDZ", None, 9),
    (8, "Port Mikla", "Mikludraia", "MDZ", None, 1), (9, "Fort Ubrel", "Mikludraia", "MDZ", None, 1), (10, "San Miguel de Allende Grande", "Mikludraia", "MDZ", None, 1),
    (4, "Davigrus", "Kaguthvior", "KTZ", [], 10), (5, "Davigrus", "Mikludraia", "MDZ", [], 99), (6, "Õö", "Mikludraia", None, [], None), (7, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "place_id long, place_name string, country_name string, country_code string, alt_names array<string>, population long")


@pytest.mark.parametrize("value, want", [
    ("Šenuhaven", 1), ("senuhaven", 1), ("  SENUHAVEN  ", 1), ("Š e n u h a v e n", 1), ("living in Šenuhvaen", 1), ("Greater Ft. Dolath Area", 2), ("F t D o l a t h(ktz)", 2), ("Ft Dloath", 2), ("Dragrovik / Kaguthvior", 2),
    ("Prt Dolath", 3), ("San Miguel de Allende Grande", 10), ("near San Migual de Alende Gran de", 10), ("San Miguel", -1), ("Davigrus, KTZ", 4), ("MDZ - Davigrus", 5), ("Davigrus", 5), ("Šenuhaven, Mikludraia", -1), ("Kaguthvior", -1), ("KTZ", -1), ("remote", -1), ("???", -1), ("🌍", -1), ("the cloud", -1),
    ("Senuhaven " + "x " * 3000, 1), ("x" * 20_000, -1),
])
def test_places(spark, places, value, want):
    df = spark.createDataFrame([(value, 1, "x"), (value, 2, "y")], "v string, entry_id long, name string")
    assert [(r.value, r.entry_id) for r in match_canonical(df, "v", place_entries(places)).collect()] == [(value, want)]


def test_places_edges(spark, places):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("Davigrus",)], "v string")
    assert match_canonical(df, "v", place_entries(places)).count() == 1
    assert match_canonical(df.where("false"), "v", place_entries(places)).count() == 0
    assert [r.entry_id for r in match_canonical(df, "v", place_entries(places.where("false"))).collect()] == [-1]


def test_prefix_join_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9)))
    names = sorted({word() for _ in range(40)})
    values = sorted({word() for _ in range(120)})
    entries = spark.createDataFrame([(i, n, [], 0) for i, n in enumerate(names)], "entry_id long, name string, context array<string>, weight long")
    got = {r.value: r.entry_id for r in match_canonical(spark.createDataFrame([(v,) for v in values], "v string"), "v", entries).collect()}
    grams = lambda w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
    for v in values:
        best = []
        for i, n in enumerate(names):
            a, b = grams(v), grams(n)
            j, e = len(a & b) / len(a | b), edits(v, n)
            if j * 4 >= 1 and e <= 2 and e * 3 <= len(n):
                best.append((round(j, 9), -e, -i))
        assert got[v] == (-max(best)[2] if best else -1)


def test_edits():
    assert [edits("abcd", x) for x in ("abcd", "abdc", "acd", "abxcd", "xbcd", "badc", "")] == [0, 1, 1, 1, 1, 2, 4]
    assert fold("Ğrumepenførd ÖŁ") == "grumepenford ol" and "sanktx" not in phrases("St X", 3) and "stx" in phrases("St X", 3) and {"saintru", "stru", "sntru"} <= forms("Saint Ru", frozenset({"saint"})) and forms("Saint Ru") == {"saintru"}


SAME = [
    ["Beletax Drobrus Institute", "beletax drobrus institute", "BELETAX DROBRUS INSTITUTE", "@beletax-drobrus-institute", "BeletaxDrobrusInstitute", "The Beletax Drobrus Institute", "Beletax Drobrus Inst.", "Institute of Beletax Drobrus",
     "Drobrus Beletax Institute", "Beletax Drobrus Institute, GmbH", "Beletax Drobrus Institute S.A.", "Beletax Drobrus Institute (remote)", "Beletax Drobrus", "Beletax DI", "Beletadro", "Beletax Drobrus nstitute", "Beletax  Drobrsu Institute", "Beletax & Co Drobrus Institute"],
    ["Fovupon Logistics", "Fovupon Log.", "Fovupon L.", "Fovupoy", "Fovupon", "FovuponLogistics", "Fovupn Logistics"],
    ["Beletax Bebrem Engineering", "Beletax Bebrem Eng. Ltd"],
    ["Kupu Limuher University"],
    ["Alpha Beta Gamma Delta Software", "Delta Gamma Bta Alpha Software", "Software Gamma Delta Alpha Beta"],
]
NOBODY = ["student", "N/A", "n/a", "-", "self-employed", "Freelancer", "???", "Open source", "", " "]


def test_names(spark):
    rows = [(v, i) for i, group in enumerate(SAME) for v in group for _ in range(2 if v == group[0] else 1)] + [(v, -1) for v in NOBODY] + [(None, -1), ("Beletax", -1)]
    linked = link_names(spark.createDataFrame(rows, "company string, entity int"), "company")
    of = {r.value: r.entity for r in linked.collect()}
    for group in SAME:
        assert len({of[v] for v in group}) == 1, {v: of[v] for v in group}
    assert len({of[g[0]] for g in SAME}) == len(SAME)
    assert not set(of) & set(NOBODY)
    assert of["Beletax"] not in {of[g[0]] for g in SAME}
    pairs = {tuple(r) for r in variant_pairs(linked).collect()}
    assert pairs == {(a, b) for g in SAME for a in g for b in g if a < b}


def test_names_are_not_broadcast(spark):
    """The driver builds what is broadcast, and every side of these joins grows with the names; the plans are those that ran."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty(30_000)
        ran = store.executionsList()
        return {ran.apply(i).executionId() for i in range(ran.size())}

    before = executions()
    rows = [(v,) for group in SAME for v in group]
    assert variant_pairs(link_names(spark.createDataFrame(rows, "company string"), "company")).collect()
    nodes = []
    for execution in executions() - before:
        graph = store.planGraph(execution).allNodes()
        nodes += [graph.apply(i).name() for i in range(graph.size())]
    assert sum(n.startswith("SortMergeJoin") for n in nodes) >= 10
    assert not [n for n in nodes if "Broadcast" in n]


def test_names_edges(spark):
    assert link_names(spark.createDataFrame([], "c string"), "c").count() == 0
    long = "x" * 3000 + " Bank"
    assert link_names(spark.createDataFrame([(long,), (None,)], "c string"), "c").count() == 1
    assert parse("S.A.") is None or parse("S.A.")[0]
    assert parse("(remote)") is None and parse("Tagreke Consulting") == (["tagreke"], "consulting")
    assert nickname(["kabrupin", "vahem"]) == "kabrupivah" and nickname(["pudibis"]) == "pudibiy" and "kasigol ds" in short_forms(["kasigol", "dranu"], "systems")
