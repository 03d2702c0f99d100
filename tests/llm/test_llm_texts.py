import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from postmill.llm import langid, pages, quality, residue, train_langid, train_pages
from postmill.llm.pages import SENTENCE, Tree, furniture, page_lines, sum_product

PAGE = """Home | Events | About us | Contact
Vacancies » Vacancies » Policy Adviser

Our office in Stubrup hosts 12 colleagues who care about field data.
What you will do:
You lead 20 people who visit sites and check water access.
Contact
Send a short letter about field data before the 3 of May.
Recently viewed
Warehouse Supervisor for river monitoring
Stubrup
© 2026 Some Trust
Privacy policy   Imprint   Sitemap"""
FURNITURE = [1, 2, 9, 10, 11, 12, 13]


def test_page_is_split():
    found = furniture(pages.load(), [PAGE, "", PAGE], ["Policy Adviser", None, None])
    assert [n for n, p in found[0] if p >= 0.5] == FURNITURE and found[1] == []


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(0)
    tree = Tree()
    tree.page([SENTENCE, SENTENCE, 4, 4, SENTENCE], 0)
    parent, depth, edge, _ = tree.arrays()
    n = len(parent)
    unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(pages.EDGES, 2, 2))
    total, want = 0.0, np.zeros((n, 2))
    for code in range(2**n):
        x = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(unary[i, x[i]] for i in range(n)) + sum(pair[edge[i], x[parent[i]], x[i]] for i in range(n) if parent[i] >= 0))
        total += w
        want[range(n), x] += w
    marginal, both, z = sum_product(parent, depth, edge, unary, pair)
    assert np.allclose(marginal, want / total) and np.isclose(z, np.log(total)) and np.allclose(both[1:].sum((1, 2)), 1)


def test_page_training_holds_out():
    texts = [PAGE.replace("Stubrup", f"Town{i}").replace("20", str(i)) for i in range(40)]
    w, pair = train_pages.train(texts[:30], [None] * 30, epochs=4)
    found = furniture(pages.Reader(w, pair), texts[30:], [None] * 10)
    assert all([n for n, p in f if p >= 0.5] == FURNITURE for f in found)


def test_page_lines_defined_results(spark):
    rows = [("a", "t", PAGE, 1), ("a", "t", PAGE, 1), (None, None, None, 2), ("b", None, "", 3), ("c", "t", "\n \n", 4), ("d", "t", "Sentence number one is here. " * 5000, 5)]
    out = page_lines(spark.createDataFrame(rows, "dedupe_key string, title string, description_text string, body int")).collect()
    got = {r.dedupe_key: r for r in out}
    assert len(out) == 6 and list(got["a"].furniture) == FURNITURE and list(got["b"].body_no) == list(got["c"].furniture) == [] and len(got["d"].body[0]) > 100000
    assert got[None].title is None


LINES = {
    "en": "We read applications as they come and reply within 12 days.",
    "de": "Wir lesen laufend und melden uns innerhalb von 12 Tagen.",
    "fr": "Nous lisons au fil de l'eau et répondons sous 12 jours.",
    "sv": "Vi läser löpande och svarar inom 12 dagar.",
    "da": "Vi læser løbende og svarer inden for 12 dage.",
    "es": "Leemos según llegan y contestamos en 12 días.",
}


def test_languages_of_lines():
    net = langid.Network.load()
    z = net.read(list(LINES.values()) + ["", "x" * 5000])
    assert [langid.LANGUAGES[i] for i in z[:6].argmax(1)] == list(LINES) and np.allclose(np.exp(z).sum(1), 1)
    assert np.allclose(z[6], z[6][0])


def test_gradient_through_time():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in train_langid.start(rng).items()}
    x, y = rng.integers(97, 105, (6, 7)).astype(np.uint8), rng.integers(0, 6, 6)
    _, g = train_langid.loss_and_gradient(p, x, y)
    for k in ("u", "w", "v", "emb"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        eps = 1e-4
        p[k][i] += eps
        hi = train_langid.loss_and_gradient(p, x, y)[0]
        p[k][i] -= 2 * eps
        lo = train_langid.loss_and_gradient(p, x, y)[0]
        p[k][i] += eps
        assert abs((hi - lo) / (2 * eps) - g[k][i]) < 2e-2 * abs(g[k][i]) + 1e-5


def test_small_network_learns():
    lines = [langid.prepared(LINES[k] + f" {w}") for k in ("en", "sv") for w in ("aa bb", "cc dd", "ee ff")]
    y = np.array([0, 0, 0, 3, 3, 3])
    net = train_langid.network(train_langid.fit(lines, y, 150))
    assert (net.read([LINES["en"], LINES["sv"]]).argmax(1) == [0, 3]).all()


def test_languages_defined_results(spark):
    rows = [("a", "Lagerchef inom kylkedjor", [LINES["en"], LINES["en"], LINES["fr"], None], [2, 3, 5, 6], "Swedish"), (None, None, [], [], None), ("b", "", None, None, "nl")]
    df = spark.createDataFrame(rows, "dedupe_key string, title string, body array<string>, body_no array<int>, lang_label string")
    got = {r.dedupe_key: r for r in langid.languages(df).collect()}
    a = got["a"]
    assert (a.lang, a.declared, a.title_lang) == ("en", "sv", "sv") and [(s.line_no, s.lang) for s in a.segments][:3] == [(2, "en"), (3, "en"), (5, "fr")]
    assert got[None].lang is None and got["b"].declared == "other" and got["b"].title_lang is None
    assert [langid.named(x) for x in ("EN-gb", "und", "", None, "Deutsch", "xy")] == ["en", None, None, None, "de", "other"]


def slot_rows():
    names = ["Ravomo", "Calypso", "Brenta", "Delvin", "Estora", "Fanubo", "Garlis", "Hestra", "Ivanto", "Jarvik", "Kelton", "Lumora"]
    body = " ".join(f"You visit site {i} and write about what people there need and want." for i in range(8))
    rows = [(f"n{i}", f"The contract with {n} runs for {i} months.\n{body}") for i, n in enumerate(names * 2)]
    rows += [(f"c{i}", f"Your notes explain what null means in our exports, and what {{{{first_name}}}} included means.\n{body}") for i in range(3)]
    rows += [(f"p{i}", f"The contract with {x} runs for 3 months.\n{body}") for i, x in enumerate(["null", "{job_title}", "__________", "[Company Name]", "<<NAME>>"])]
    rows += [(f"e{i}", "404 Not Found\nThe page you were looking for could not be found.") for i in range(4)]
    rows += [("f", f"Sample text, replace before publishing.\n{body}"), ("l", f"Lorem ipsum dolor sit amet vix.\n{body}"), ("script", f"{body}\nJavaScript is switched off; some features may not work.")]
    rows += [("rare", f"{body}\nZebras in ${{town}} graze."), ("soon", "Text folgt in Kürze durch die Fachabteilung.")]
    return rows + [("empty", ""), ("null", None), (None, "Access denied. You do not have permission to view this page."), ("long", body * 300)]


def test_residue(spark):
    rows = slot_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[-1:]], "dedupe_key string, description_text string, reason string")
    got = {r.dedupe_key: r.reason for r in residue.find_residue(df).collect()}
    want = {f"p{i}": "placeholder" for i in range(5)} | {f"e{i}": "page" for i in range(4)} | {"f": "filler", "l": "filler", "soon": "filler", "rare": "placeholder", None: "page"}
    assert got == want
    assert residue.find_residue(df.limit(0)).count() == 0


def test_positions_align():
    text = "The contract with null runs for 3 months.\n* Interviews take place in null during May."
    found = {residue.position_key(p) for p, w, _ in residue.residues(text)}
    marked = np.ones(residue.POSITIONS, dtype=bool)
    words = dict.fromkeys(found, 0)

    class Seen(dict):
        def __missing__(self, k):
            return 0

    seen = Seen()
    residue.Slots(marked).count([text], seen)
    assert len(found) == 2 and found <= set(seen) and words is not None


DOCS = {
    "prose": "We started the work in May and you will lead it. Our rooms are quiet, and they are close to the station.\n\nWhat you will do\n\nYou visit the sites and write about what you have seen there.",
    "list": "\n".join(f"- {w}" for w in ("soil mapping", "legal aid", "river monitoring", "seed storage", "field data", "school meals") * 3),
    "table": "\n".join(f"| RQ{i:05d} | Oslo | {i * 37} | yes |" for i in range(12)),
    "junk": "\n".join(f"dru.den:{i}94 at 0x16d6bb{i} [TRACE]" for i in range(10, 30)),
}


def test_structure_of_texts():
    p = quality.Profiles.load()
    extra = [DOCS["prose"].upper(), "soil mapping Tagen Norra " * 60, "46 6108 60300859 19095 5980082 24 " * 9, "", "a\tb\t12\nc\td\t15\ne\tf\t11"]
    kinds = [m[-2] for m in quality.measured([*DOCS.values(), *extra], p)]
    assert kinds == ["prose", "list", "table", "junk", "prose", "junk", "junk", "blank", "table"]


def test_divergence():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([[0.0, 1.0], [0.5, 0.5]])
    d = quality.divergence(p, q)
    assert np.isclose(d[0, 0], 1) and np.isclose(d[1, 1], 0) and 0 < d[0, 1] < 1


def test_quality_defined_results(spark):
    rows = [(i, t, "x") for i, t in enumerate(DOCS.values())] + [(None, None, "x"), (9, " \n ", "x"), (9, " \n ", "x"), (10, DOCS["prose"] * 2000, "x")]
    out = quality.text_quality(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()
    assert len(out) == 8 and {r.doc_id: r.kind for r in out}[None] == "blank" and {r.doc_id: r.kind for r in out}[10] == "junk"
    assert all(abs(r.prose_share + r.list_share + r.table_share + r.junk_share - 1) < 1e-9 for r in out if r.kind != "blank")


def test_long_records_are_read_whole(spark):
    body = "\n".join(f"You visit site number {i} and write about what people need." for i in range(8))
    odd = ["blah blah blah", "test", "Fylls  i av avdelningen.", "Wird noch von der Abteilung\xa0 ergänzt.", "Lorem ipsum dolor sit amet, magna aliqua."]
    rows = [(f"o{i}", f"{body}\n{x}") for i, x in enumerate(odd)] + [("plain", body), ("test", f"{body}\nTest the pumps in May.")]
    df = spark.createDataFrame(rows, "dedupe_key string, description_text string")
    assert {r.dedupe_key: r.reason for r in residue.find_residue(df).collect()} == {f"o{i}": "filler" for i in range(len(odd))}
    # What is passed over by hints and memos is what the patterns alone pass over.
    for x in [*odd, *(t for _, t in slot_rows() if t), "Http  error 500", "Please enable\tJavaScript now.", "Seite  nicht  gefunden", "The scripts must run here."]:
        for line in x.split("\n"):
            plain = [(s, bool(residue.FILLER.search(s)), bool(residue.ERROR.search(s))) for s in residue.templates(line)]
            assert residue.telling(line)[0] == residue.telling(line, hinted=False)[0] == [p for p in plain if p[1] or p[2]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_hints_pass_over_nothing_that_the_patterns_find():
    table = pq.read_table("/root/testdata/sf0.01/jobs.parquet", columns=["description_text"])
    for line in {x for t in table["description_text"].to_pylist() if t for x in t.split("\n")}:
        assert residue.telling(line) == residue.telling(line, hinted=False)


def test_sample_words_are_learnt_from_their_lines(spark):
    """Words that come beside those of the common sample paragraph are sample words; those of real lines are not."""
    body = "\n".join(f"You visit site number {i} and write about what people need." for i in range(8))
    sample = ["Belsa vona amet nobir vona mundat dubir pravi.", "Vona mundat belsa dolor nobir, pravi dubir.", "Lorem nobir belsa mundat vona dubir pravi sit."]
    rows = [(f"s{i}", f"{body}\n{x}") for i, x in enumerate(sample)]
    # Without a seed in its line a sentence is not looked at; with one it must still be sample words for the most part.
    rows += [("unseeded", f"{body}\nBelsa vona nobir mundat dubir."), ("after", f"{body}\nBelsa vona nobir mundat dubir. Amet vona.")]
    rows += [(f"r{i}", f"{body}\nEl dolor de la rodilla numero {i} es tratado aqui.") for i in range(5)]
    rows += [(f"q{i}", f"{body}\nEl medico de la sala numero {i} es tratado aqui.") for i in range(20)]
    df = spark.createDataFrame(rows, "dedupe_key string, description_text string")
    assert {r.dedupe_key: r.reason for r in residue.find_residue(df).collect()} == {k: "filler" for k in ("s0", "s1", "s2", "after")}


def test_bracketed_forms_after_labels():
    for line in ("Location: [Insert city]", "Your manager: [object Object]", "Team: <<TEAM_NAME>>", "Salary: (to be confirmed)", "Start: [Date]"):
        assert residue.residues(line), line
    for line in ("[Apply] | [Save]", "Engineer [Field Work]", "Analyst (your chance)"):
        assert not [x for x in residue.residues(line) if x[1] != "(your chance)"], line


def test_unmistakable_forms_where_few_fillers_stand(spark):
    rows = slot_rows()
    body = rows[0][1].split("\n")[1]
    for i, who in enumerate(["Eva Lind", "Per Dahl", "{{contact}}", "{{contact}}", "{{contact}}", "<<FULL NAME>>"]):
        rows.append((f"s{i}", f"{body}\nPlease write to {who} before summer."))
    for i, who in enumerate(["Olsen", "Dahl", "Krog", "{{desk}}", "{{desk}}", "{{desk}}"]):
        rows.append((f"w{i}", f"{body}\nLetters reach {who} by noon."))
    df = spark.createDataFrame(rows, "dedupe_key string, description_text string")
    got = {r.dedupe_key: r.reason for r in residue.find_residue(df).collect()}
    assert {k for k in got if k and k[0] in "sw" and k != "soon"} == {"s2", "s3", "s4", "s5", "w3", "w4", "w5"}
    assert not {"c0", "c1", "c2"} & set(got)


def test_long_tokens_count_whole():
    p = quality.Profiles.load()
    for n in (63, 64, 76, 10_000, 3_000_000):
        m = dict(zip(quality.FIGURES, quality.measured(["a" * n + " " + "5" * n + " ab"], p)[0]))
        assert m["n_words"] == 2 and m["mean_word_length"] == (n + 2) / 2 and abs(m["digit_ratio"] - n / (2 * n + 2)) < 1e-12
    d = dict(zip(quality.FIGURES, quality.measured(["we read " + "=" * 500], p)[0]))
    assert d["symbol_ratio"] == 500 / 506 and d["mean_word_length"] == 3 and d["verbal_words"] == 0.5


def test_error_lines_of_any_length(spark):
    long = "The page was not found, " + "and you may look for it in the other parts of this site or ask the people who keep it, " * 6 + "thank you"
    body = "\n".join(f"You visit site number {i} and write about what people need." for i in range(8))
    rows = [(f"e{i}", long) for i in range(4)] + [("plain", body)]
    df = spark.createDataFrame(rows, "dedupe_key string, description_text string")
    assert {r.dedupe_key: r.reason for r in residue.find_residue(df).collect()} == {f"e{i}": "page" for i in range(4)}


def test_unlisted_error_pages_by_recurrence(spark):
    body = "\n".join(f"You visit site number {i} and write about what people need." for i in range(8))
    rows = [(f"e{i}", "Oops, this shelf is bare at present.") for i in range(3)] + [(f"two{i}", "Nothing to see on this shelf.") for i in range(2)]
    rows += [(f"v{i}", f"{body}\nThe kettle is always warm.") for i in range(3)] + [("v3", "The kettle is always warm.")]
    df = spark.createDataFrame(rows, "dedupe_key string, description_text string")
    assert {r.dedupe_key: r.reason for r in residue.find_residue(df).collect()} == {f"e{i}": "page" for i in range(3)}


def test_long_lines_are_read_in_one_go(monkeypatch):
    net = langid.Network.load()
    line = "We write about what the people of the village need, and you visit them. " * 40
    want = net.read([line, "Wir suchen dich", line[:700]])
    monkeypatch.setattr(langid, "STRETCH", 7)
    monkeypatch.setattr(langid, "POSITIONS", 100)
    assert np.allclose(net.read([line, "Wir suchen dich", line[:700]]), want, atol=1e-4)
    # The state is carried over the whole line: the sums of positions are those of one pass over all bytes.
    x = np.frombuffer(langid.prepared(line), dtype=np.uint8)[None]
    whole = net.logits(x, np.array([x.shape[1]]))[0] / np.sqrt(x.shape[1])
    whole -= whole.max()
    assert np.allclose(np.exp(want[0]), np.exp(whole) / np.exp(whole).sum(), atol=1e-4)


def test_record_pools_the_probabilities_of_its_lines():
    z = np.log(np.array([[0.4, 0.6, 0, 0, 0, 0], [0.9, 0.1, 0, 0, 0, 0], [0.45, 0.55, 0, 0, 0, 0]]) + 1e-12)
    lang, conf, *_ = langid.judged(z, ["a b c d", "e f g h", "i j k l"], [1, 2, 3], None, 0.6)
    # Two of three lines have "de" ahead by little; pooled, "en" has 7 of 12 words.
    assert lang == "en" and abs(conf - 1.75 / 3) < 1e-6


def test_languages_of_pages_in_one_pass(spark):
    rows = [("a", "Policy Adviser", PAGE, "en"), ("b", None, PAGE, None), ("c", "x", None, "sv"), (None, "", "", "de"), ("d", "Rådgivare", "Vi söker dig som vill arbeta med vatten.\n" * 3, "English")]
    df = spark.createDataFrame(rows, "dedupe_key string, title string, description_text string, lang_label string")
    two = sorted(map(repr, langid.languages(page_lines(df, also=("lang_label",))).collect()))
    assert two == sorted(map(repr, langid.page_languages(df).collect())) and len(two) == len(rows)
    assert langid.page_languages(df.limit(0)).count() == 0
