import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from koengine.llm import names, ocr, pii, survivor
from koengine.llm.boost import BoostedTrees


# ---- names

KB = [
    ("p1", "Robert Haklister", "Person", []), ("p2", "Gabrielle Staustar", "Person", ["Gabi Staustar"]), ("p3", "Victoria K. Taufulund", "Person", []), ("p4", "Katherine Taufulund", "Person", []), ("p5", "Johannes Brutaun", "Person", []), ("p6", "Josephine Brutaun", "Person", []),
    ("f1", "Mockgovik International Instruments LLC", "Organization", []), ("f2", "Klasshovik Foods GmbH", "Organization", []), ("f3", "Tipidal Engineering Oy", "Organization", []), ("f4", "Zonwemere & Skartgron Instruments Ltd", "Organization", []),
    ("f5", "Toworic Engineering AB", "Organization", []), ("f6", "Greisein Instruments Pty Ltd", "Organization", []), ("f7", "Lebimere Foods Pty Ltd", "Organization", []), ("f8", "Soxkedal International Foods Oy", "Organization", []), ("f9", "Wauwaun International Engineering SA", "Organization", []),
]
MEANS = {
    "rob hajlister": "p1", "Haklister, R.": "p1", "HAKLISTER ROBERT": "p1", "Prof. Róbert Haklister": "p1", "Staustaar Gabrielle": "p2", "Vicky K. Taufulund": "p3", "Kate Taufulund": "p4", "Mockgovik Intl Instr. L.L.C.": "f1", "Klásshovik Fds": "f2",
    "MockgovikInternationalInstruments": "f1", "Indtruments of Zonemere and Skartgron": "f4", "Mockgovik": "f1", "MIIL": "f1", "Robert Haklister": "p1", "Tipidal  Engg Oy": "f3",
}
NONE = ["Robert Zandvik", "Susan Haklister", "Klasshovik Instruments GmbH", "Port Tipidal", "R. Taufulund", "", "   ", None, "Haklister", "12345", "Victoria Q. Taufulund"]


def test_links(spark):
    df = spark.createDataFrame([(n, 1) for n in [*MEANS, *NONE, *list(MEANS)[:3]]], "name string, koid int")
    kb = spark.createDataFrame(KB, "koid string, name string, type_name string, aliases array<string>")
    got = {r["name"]: r["koid"] for r in names.link_names(df, kb).collect()}
    assert got == MEANS
    # short for two: the cluster of higher average linkage, if their averages differ at all
    two = names.link_names(spark.createDataFrame([("Jo Brutaun",)], "name string"), kb).collect()
    assert len(two) <= 1 and all(r["koid"] in ("p5", "p6") for r in two)
    assert names.link_names(df.limit(0), kb).count() == 0
    assert names.link_names(df, kb.limit(0)).count() == 0


def test_short_forms_outside_every_list(spark):
    """Short forms are known by their sound, or learned from families and aliases."""
    fam = ["Haklister", "Staustar", "Brutaun", "Tipidal", "Lebimere", "Wauwaun"]
    kb = [(f"k{i}", f"{g} {f}", "Person", []) for i, (g, f) in enumerate(zip(["Anthony", "Rebecca", "Michael", "Samuel", "Jennifer", "Margaret"], fam))]
    kb += [(f"m{i}", f"Wolfgang {f}", "Person", ["Butz Zonwemere"] if f == "Zonwemere" else []) for i, f in enumerate(["Zonwemere", "Greisein", "Soxkedal", "Klasshovik", "Toworic"])]
    want = {"Tony Haklister": "k0", "Becky Staustar": "k1", "Mike Brutaun": "k2", "Sam Tipidal": "k3", "Jenny Lebimere": "k4", "Butz Greisein": "m1", "Butz Soxkedal": "m2", "Klaßhovik, Butz": "m3", "Butz Tovoric": "m4"}
    rows = spark.createDataFrame([(n,) for n in [*want, "Carl Haklister", "Bruno Wauwaun", "Butz Haklister"]], "name string")
    links = names.link_names(rows, spark.createDataFrame(kb, "koid string, name string, type_name string, aliases array<string>"))
    assert {r["name"]: r["koid"] for r in links.collect()} == want


def test_sparse_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    unit = lambda v: {d: x / sum(y * y for y in v.values()) ** 0.5 for d, x in v.items()}
    make = lambda: {i: unit({rng.randrange(12): rng.random() + 0.1 for _ in range(4)}) for i in range(60)}
    a, b = make(), make()
    df = lambda m: spark.createDataFrame([(i, d, w) for i, v in m.items() for d, w in v.items()], "id long, dim long, w double")
    monkeypatch.setattr(names, "HOT_PRODUCTS", 50)  # most dimensions are hot here
    got = {(r["a"], r["b"]): r["cosine"] for r in names.sparse_join(df(a), df(b), least=0.5, top_n=3).collect()}
    want = {}
    for i, u in a.items():
        near = sorted(((sum(x * v.get(d, 0) for d, x in u.items()), j) for j, v in b.items()), reverse=True)
        for c, j in near:
            if c >= 0.5 and round(c, 9) >= round(near[2][0], 9):
                want[i, j] = c
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_average_linkage_against_one_merge_at_a_time(spark):
    rng = random.Random(5)
    nodes = list(range(40))
    sim = {(a, b): round(rng.random(), 6) for a in nodes for b in nodes if a < b and rng.random() < 0.3}
    got = {}
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a long, b long, s double")
    for r in names.average_linkage(spark.createDataFrame([(n,) for n in nodes], "node long"), edges, 0.4).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    sets = [{n} for n in nodes]
    mean = lambda x, y: round(sum(sim.get((min(a, b), max(a, b)), 0) for a in x for b in y) / len(x) / len(y), 9)
    while True:
        best = max(((mean(x, y), i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j), key=lambda t: t[0])
        if best[0] < 0.4:
            break
        sets[best[1]] |= sets[best[2]]
        del sets[best[2]]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, sets))


def test_groups_of_names_without_an_entry(spark):
    kb = spark.createDataFrame(KB, "koid string, name string, type_name string, aliases array<string>")
    ann, firm = ["Annabel Quorndale", "annabel quorndael", "Quorndale, Annabel", "A. Quorndale"], ["Zibbermann Shipping Ltd", "Zibberman Shipping", "ZIBBERMANN SHIPPING LIMITED"]
    rows = [*ann, *firm, "Peter Quorndale", "Rob Haklister", "Robert Haklister", "", None]
    got = {r["name"]: r["group"] for r in names.group_names(spark.createDataFrame([(n,) for n in rows], "name string"), kb).collect()}
    assert set(got) == {n for n in rows if n}
    assert got["Rob Haklister"] == got["Robert Haklister"] == "p1"
    assert len({got[n] for n in ann[:3]}) == 1 and len({got[n] for n in firm}) == 1
    assert got["Peter Quorndale"] not in {got[n] for n in ann[:3]}


def test_edits():
    assert names.edits("abcd", "abdc") == 1 and names.edits("abc", "abc") == 0 and names.edits("a", "abcd") == 3 and names.edits("kitten", "sitting", 3) == 3


# ---- survivors


def brute_survivors(rows):
    groups = {}
    for r in rows:
        if None in (r[0], r[1], r[2]):
            continue
        groups.setdefault((r[0], r[1]), {})[r[2]] = r
    out = set()
    for g, by in groups.items():
        if len(by) < 2:
            continue
        for f, at in (("a", 5), ("b", 6)):
            good = [r for r in by.values() if r[at] is not None and "".join(r[at].split()).lower() not in ("", "-", "unknown", "n/a") and not r[at].rstrip().endswith(("…", "..."))]
            if not good:
                continue
            key = lambda r: "".join(r[at].split()).lower()
            best = max(good, key=lambda r: (r[3] if r[3] is not None else -1, r[4], key(r)))
            out.add((f, min(r[2] for r in good if key(r) == key(best))))
    return out


def test_survivors_against_brute_force(spark):
    rng = random.Random(2)
    vals = ["Alpha", " alpha", "beta", "Beta ", None, "", "-", "unknown", "bet…", "gam...", "N/A", "delta"]
    rows = []
    for i in range(400):
        rows.append((f"d{rng.randint(0, 40)}", rng.choice(["k1", "k2", None]), i, rng.choice([0.1, 0.5, 0.9, None]), i * 7 % 401, rng.choice(vals), rng.choice(vals)))
    rows += [("hot", "k", 1000 + i, i / 1000, i, vals[i % len(vals)], vals[(i * 5) % len(vals)]) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:50], "doc string, koid string, id long, conf double, at long, a string, b string").withColumn("bundle", F.lit("clash"))
    got = survivor.survivors(df, group=("doc", "koid"), key="id", bundles=(("a",), ("b",)), trust=(F.col("conf"), F.col("at")))
    assert {(r["field_name"], r["id"]) for r in got.collect()} == brute_survivors(rows)
    assert survivor.survivors(df.limit(0), group=("doc", "koid"), key="id", bundles=(("a",), ("b",)), trust=(F.col("conf"),)).count() == 0


def test_bundles_survive_together(spark):
    rows = [("g", 1, 0.9, "12 High Rd", "Leffring", "LF1"), ("g", 2, 0.8, "9 Low Rd", "Quellin", "QU7"), ("g", 3, 0.95, None, None, "QU7")]
    df = spark.createDataFrame(rows, "g string, id long, conf double, street string, city string, code string")
    got = survivor.survivors(df, group=("g",), key="id", bundles=(("street", "city"), ("code",)), trust=(F.col("conf"),))
    assert {(r["field_name"], r["id"]) for r in got.collect()} == {("street", 1), ("city", 1), ("code", 2)}


def test_dependent_bundles_give_up_trust_for_agreement(spark):
    rows = [("g", i, t, v, x, p, x) for i, (t, v, x, p) in enumerate([(0.9, "A", "ocr", None), (0.6, "B", "pdf", "7"), (0.5, "C", "ocr", "-"), (0.55, "D", "pdf", "9")])]
    rows += [("hot", 100 + i, i / 5000, f"v{i}", "ocr" if i % 2 else "pdf", str(i), "ocr" if i % 2 else "pdf") for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, id long, conf double, val string, ext string, page string, pext string")
    got = survivor.survivors(df, group=("g",), key="id", bundles=(("val", "ext"), ("page", "pext")), trust=(F.col("conf"),), dependencies=(("ext", "pext"),)).collect()
    by = lambda g: {r["field_name"]: r["value"] for r in got if r["g"] == g}
    # the ocr value (0.9) with the ocr row's empty place (0.9) beats the pdf pair (0.6 + 0.6)
    assert by("g") == {"val": "A", "ext": "ocr", "pext": "ocr"}
    assert by("hot") == {"val": "v3999", "ext": "ocr", "page": "3999", "pext": "ocr"}


def test_branch_and_bound_against_all_choices():
    import itertools

    rng = random.Random(4)
    for _ in range(60):
        cands = [sorted([(rng.randint(1, 9), (rng.choice("xyz"), rng.choice("xyz"))) for _ in range(rng.randint(0, 4))], reverse=True) for _ in range(3)]
        ties = [(0, 0, 1, 0), (1, 1, 2, 1)]
        best = 0
        for pick in itertools.product(*[range(-1, len(c)) for c in cands]):
            if all(pick[a] < 0 or pick[b] < 0 or cands[a][pick[a]][1][i] == cands[b][pick[b]][1][j] for a, i, b, j in ties):
                best = max(best, sum(cands[n][p][0] for n, p in enumerate(pick) if p >= 0))
        got = survivor.choose_bundles(cands, ties)
        assert sum(cands[n][p][0] for n, p in enumerate(got) if p >= 0) == best


# ---- scans


def test_boosted_trees_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    assert len(m.predict(np.zeros((0, 4)))) == 0


@pytest.fixture(scope="module")
def scanned(spark):
    """Pages of a small invented language of frequent words, with planted noise."""
    rng = random.Random(8)
    words = "ledger station carriage platform signal ticket cabinet corridor journey passenger conductor timetable lantern window bridge whistle engine freight harbour compass".split()
    pages, truth = [], set()
    for doc in range(30):
        for page in range(1, 5):
            pid = doc * 10 + page
            lines = [f"Handbook of the {words[doc % 20]}s", ""]
            truth.add((pid, 1, "running_line"))
            for _ in range(14):
                lines.append(" ".join(rng.choice(words) for _ in range(8)))
            body = range(2, len(lines))
            for i in rng.sample(list(body), 3):
                ws = lines[i].split()
                j = rng.randrange(1, 7)
                bad = ocr.corrupt(ws[j], rng)
                if bad != ws[j] and bad not in words:
                    ws[j] = bad
                    lines[i] = " ".join(ws)
                    truth.add((pid, i + 1, "misread"))
            for i in rng.sample(list(body)[:-1], 2):
                w = rng.choice(words)
                cut = rng.randrange(2, len(w) - 1)
                lines[i] += " " + w[:cut] + "-"
                lines[i + 1] = w[cut:] + " " + lines[i + 1]
                truth.add((pid, i + 1, "hyphen"))
            lines += ["", f"Page {page} of 4"]
            truth.add((pid, len(lines), "page_number"))
            pages.append((pid, f"d{doc}", page, "\n".join(lines)))
    pages += [(9001, "e", 1, None), (9002, "e", 2, ""), (9003, "e", 3, " \n "), pages[0]]
    df = spark.createDataFrame([(*p, -1.0, None) for p in pages], "page_id long, document_id string, page int, text string, confidence float, words array<struct<text:string,confidence:float,line_num:int>>")
    return df, truth


def test_noise(spark, scanned):
    df, truth = scanned
    got = {tuple(r) for r in ocr.noise_table(ocr.detect(df)).collect()}
    for kind, least in (("running_line", 1.0), ("page_number", 1.0), ("hyphen", 0.95), ("misread", 0.9)):
        want, have = {t for t in truth if t[2] == kind}, {t for t in got if t[2] == kind}
        assert len(want & have) >= least * len(want), kind
        assert len(have - want) <= 0.05 * len(have), kind


def test_repair(spark, scanned):
    df, _ = scanned
    text = " ".join(r["text"] for r in ocr.repair(df.where("document_id = 'd1'").unionByName(df.where("document_id <> 'd1'"))).where("document_id = 'd1'").orderBy("paragraph_no").collect())
    assert "Handbook" not in text and "Page 1" not in text and "- " not in text
    assert ocr.noise_table(ocr.detect(df.limit(0))).count() == 0


# ---- personal information


def sentences(rng):
    given = "Delphine Harriet Robert Ursula Quentin Ignacio".split()
    family = [a + b for a in ("Brun", "Hax", "Mil", "Tor", "Vel", "Zan") for b in ("drik", "lund", "mere", "ster", "vik")]
    name = f"{rng.choice(given)} {rng.choice(family)}"
    phone = rng.choice([f"+44 7700 900{rng.randint(100, 999)}", f"({rng.randint(200, 999)}) 555-01{rng.randint(10, 99)}"])
    ident = rng.choice([f"{rng.randint(900, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", f"QQ {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} C"])
    mail = f"x{rng.randint(1, 999)}@example.org"
    place = f"{rng.randint(1, 99)} Copper Road, Harnsby"
    return rng.choice([
        (f"Reported by {name}; insurance no. {ident}.", [("NAME", name), ("ID_NUMBER", ident)]), (f"Reach {name} on {phone} before noon.", [("NAME", name), ("PHONE", phone)]), (f"tel {phone} / mail {mail}", [("PHONE", phone), ("EMAIL", mail)]),
        (f"The claimant, {name}, lives at {place}.", [("NAME", name), ("ADDRESS", place)]), ("Offset 3853 6403 6403 in segment 03.", []), ("According to Dretron Shipping LLC, block 46 is final.", []), ("Run of 2025-06-16 06:46:00 gave 4190/2311.", []),
        (f"Identity number on file: {ident}", [("ID_NUMBER", ident)]), ("The rack in Harnsby holds 60 rows.", []),
    ])


def test_personal_information(spark):
    rng = random.Random(6)
    rows, truth = [], set()
    for i in range(400):
        text = ""
        for _ in range(3):
            s, items = sentences(rng)
            for kind, item in items:
                truth.add((i, kind, len(text) + s.index(item)))
            text += s + rng.choice([" ", "\n"])
        rows.append((i, text))
    rows += [(9000, None), (9001, ""), (9002, "  "), rows[0]]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("key", F.lit("clash")).withColumn("score", F.lit(1))
    people = spark.createDataFrame([("Delphine Xan",), ("Harriet Yol",), ("Robert Zed",), (None,)], "name string")
    found = pii.find_personal(df, people, key="id", text="text")
    got = {(r["key"], r["pii_type"], r["start_at"]) for r in found.collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.02 * len(got)
    red = {r["id"]: r["text"] for r in pii.redact(df, found, key="id", text="text").collect()}
    assert len(red) == 403 and red[9000] is None and red[9002] == "  "
    assert not any("555-01" in t or "@example" in t for t in red.values() if t)
    assert pii.find_personal(df.limit(0), people, key="id", text="text").count() == 0
