"""Layout reading, and the library from import to verdict."""

import pytest

from lectern.api import Library
from lectern.operators import layout as L
from lectern.operators import repair as R
from lectern.operators import store

PAGES = (
    "arXiv:2101.00001v1\n        A Study of Robust Things\n           in Two Lines\n  Ann Lee1,*   Bo Ray2\n\n I. I NTRODUCTION            B. Sensor Setup of Para-\nThis is prose of the left.   meters\n"
    "1. Interaction models take into account\n\f"
    "Table 1: Results of all\n\n  Method     Acc    Time\n  Ours       0.91   12\n  Baseline   0.85   9\n  Other             7\n\nThe loss is given in the next line for all of us.\n    L = \u2211 x_i + \u03bb y        (3)\n"
    "2.1 Data and Labels\n3 University of Warsaw, Poland\nREFERENCES\n4. Not A Heading Anymore\n"
)


def test_headings_and_title():
    assert [(h["text"], h["level"], h["page"]) for h in L.headings(PAGES)] == [("I. INTRODUCTION", 2, 1), ("B. Sensor Setup of Parameters", 3, 1), ("2.1 Data and Labels", 3, 2), ("REFERENCES", 2, 2)]
    assert L.title(PAGES) == "A Study of Robust Things in Two Lines"
    assert L.headings(None) == [] and L.title("") is None


def test_tables_and_equations():
    (t,) = L.tables(PAGES)
    assert t == {"number": "1", "page": 2, "markdown": "| Method | Acc | Time |\n| --- | --- | --- |\n| Ours | 0.91 | 12 |\n| Baseline | 0.85 | 9 |\n| Other |  | 7 |"}
    assert L.equations(PAGES) == [{"label": "3", "page": 2, "latex": "L = \\sum x_i + \\lambda y"}]


def test_markdown_with_layout():
    md = "Ann Lee\nI. INTRODUCTION This is prose.\nL = S x (3)\nA text ends. 2.1 Data and Labels Then more."
    got = L.with_layout(md, PAGES)
    assert got.startswith("# A Study of Robust Things in Two Lines\n")
    assert "## I. INTRODUCTION\n\nThis is prose." in got and "$$\nL = \\sum x_i + \\lambda y \\tag{3}\n$$" in got
    assert "A text ends.\n\n### 2.1 Data and Labels\n\nThen more." in got
    assert L.with_layout(md, None) == md


def test_block_passes_leave_fences():
    text = "```\na  b\n1  2\n```\na  b\n1  2"
    assert R.tables_ruled(text) == "```\na  b\n1  2\n```\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert R.math_flush("  x\n  $$\n   y\n$$\n  z") == "  x\n$$\ny\n$$\n  z"
    assert R.references_listed("no list") == "no list"


def test_library(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    bib = spark.createDataFrame([("@a{k, title={On Cats}, author={A. Lee}, year=2001, doi={https://doi.org/10.1234/cats}}\n@a{x, title={No DOI}}",), ("@a{d, title={On Dogs}, doi={10.1234/dogs}}\n@a{e, title={Again}, doi={10.1234/cats}}",)], "text string")
    assert lib.import_bibtex(bib) == 2 and lib.import_bibtex(bib) == 0
    texts = spark.createDataFrame([("10.1234/cats", "# Intro\nThe cat sat on the mat and slept.\n## More\nAll day long."), ("10.9/none", "x")], "doi string, text string")
    assert lib.index(texts) == 1 and lib.index(texts) == 0
    assert [r.doi for r in lib.search_citations("cats mats").collect()] == ["10.1234/cats"]
    assert [r.doi for r in lib.search_citations("n dog").collect()] == ["10.1234/dogs"]
    page = lib.read_content("10.1234/cats", None, 10)
    assert page["text"] == "# Intro\nTh" and lib.read_content("10.1234/cats", page["next_cursor"], 10)["text"] == "e cat sat "
    assert lib.read_content("10.1234/dogs") is None
    quotes = spark.createDataFrame([(1, "cat SAT on the mat", None), (2, "never seen in here", None), (3, "mat and slept. ## More All", None), (4, "cat sat on a mat and slept", "10.1234/cats"), (5, "cat sat on the mat", "10.1234/dogs"), (6, "cat sat on the mat", "10.1/no"), (7, "tiny", None)], "quote_id long, quote string, doi string")
    said = {r.quote_id: r for r in lib.verify_quotes(quotes).collect()}
    assert {k: (r.status, r.verdict) for k, r in said.items()} == {1: ("ok", "exact"), 2: ("ok", "not-found"), 3: ("ok", "exact"), 4: ("ok", "close-match"), 5: ("no-markdown", None), 6: ("unknown-doi", None), 7: ("quote-too-short", None)}
    assert said[1].matches[0].doi == "10.1234/cats" and said[1].matches[0].section_path == ["Intro"] and said[1].matches[0].chunk_ordinal == 0
    assert said[3].matches[0].section_path is None and "slept. ## more all" in said[3].matches[0].snippet
    assert said[4].matches[0].similarity == 0.86 and said[4].matches[0].section_path == ["Intro"]
    assert lib.index_summary(texts).first().asDict() == {"scanned": 2, "indexed": 0, "unchanged": 1, "missing_markdown": 1, "errors": 1}
    first = lib.search_page("cats", limit=1)
    assert [r["doi"] for r in first["results"]] == ["10.1234/cats"] and first["results"][0]["matches"][0]["snippet"].startswith("# Intro\nThe <b>cat</b> sat") and first["next_cursor"] is None
    walk = lib.search_page("on", limit=1)
    assert [r["doi"] for r in walk["results"]] == ["10.1234/dogs"] and walk["next_cursor"]
    assert [r["doi"] for r in lib.search_page("on", walk["next_cursor"], 1)["results"]] == ["10.1234/cats"]
    rescue = lib.search_page("n dog")
    assert [r["doi"] for r in rescue["results"]] == ["10.1234/dogs"] and rescue["results"][0]["matches"] == []
    changed = spark.createDataFrame([("10.1234/cats", "# Intro\nThe ferret sat.")], "doi string, text string")
    before = lib.store.state()["citations"]
    assert lib.index(changed) == 1 and lib.store.state()["citations"] == before
    assert [r.doi for r in lib.search_citations("mats").collect()] == [] and [r.doi for r in lib.search_citations("ferrets").collect()] == ["10.1234/cats"]
    lib.record_downloads(spark.createDataFrame([(1, "10.1234/cats", "unpaywall", "/lib/pdf/k.pdf", "open-access"), (2, "10.1234/dogs", "arxiv", None, None), (3, "10.9/none", "arxiv", None, None)], "seq long, doi string, source string, pdf_path string, access_type string"))
    assert lib.get_citation("10.1234/cats").first().pdf_path == "/lib/pdf/k.pdf" and lib.get_citation("10.1234/cats").first().access_type == "open-access"
    assert [(r.source, r.success) for r in lib.retrieval_log("10.1234/dogs").collect()] == [("arxiv", False)]
    found = lib.texts_of(spark.createDataFrame([("/lib/markdown/k.md", "# New")], "path string, text string"))
    assert [tuple(r) for r in found.collect()] == [("10.1234/cats", "# New")]
    stale = lib.store.version()
    lib.set_access("10.1234/cats", "subscription")
    with pytest.raises(store.Conflict):
        lib.store.commit(base=stale, chunks=lib.table("chunks"))
    done = lib.reextract(spark.createDataFrame([("10.1234/cats", "x"), ("10.1234/dogs", None)], "doi string, content string"), lambda s: s.map(lambda x: x and f"# {x} text"))
    assert done.first().asDict() == {"processed": 2, "extracted": 1, "failed": 1, "indexed": 1}
    lib.set_status("10.1234/dogs", "verified")
    assert lib.get_citation("10.1234/dogs").first().verification_status == "verified"
    assert lib.list_citations(limit=1).first().next_cursor
    assert {r["name"]: r.n for r in lib.reset(True).collect()} is not None and lib.table("citations").count() == 0


def test_tables_by_order_and_beside():
    packed = "Table 3: Ablation\n\n  Name                 K=1           K=6\n              A  minADE minFDE minADE minFDE\n  Ours [9]    X  1.1    2.2    0.7    1.3\n  Base [8]       1.2    2.4    0.8    1.5\n"
    (t,) = L.found_tables(packed)
    assert t["placement"] == "below" and t["markdown"].split("\n") == [
        "| Column 1 | A | minADE (K=1) | minFDE (K=1) | minADE (K=6) | minFDE (K=6) |",
        "| --- | --- | --- | --- | --- | --- |",
        "| Ours [9] | X | 1.1 | 2.2 | 0.7 | 1.3 |",
        "| Base [8] |  | 1.2 | 2.4 | 0.8 | 1.5 |",
    ]
    side = "\n".join(f"prose of the left column                 m{k}      {k}.5     {k}.7" for k in range(4)) + "\nprose again here                         Table 2: On the side\n"
    (t,) = L.found_tables(side)
    assert t == {"number": "2", "page": 1, "placement": "above", "markdown": "| m0 | 0.5 | 0.7 |\n| --- | --- | --- |\n| m1 | 1.5 | 1.7 |\n| m2 | 2.5 | 2.7 |\n| m3 | 3.5 | 3.7 |"}


def test_tables_are_spliced_once():
    md = "As shown in Table 1, all is well.\nTable 1: Results of all\n\nMethod Acc Time Ours 0.91 12 Baseline 0.85 9\n\nProse that goes on.\nTable 1: again"
    got = L.tables_spliced(md, PAGES)
    assert got.count("| Method | Acc | Time |") == 1 and "Baseline 0.85 9\n" not in got
    assert got.index("Table 1: Results of all\n\n| Method") < got.index("Prose that goes on.")
    assert L.tables_spliced("no table here", PAGES) == "no table here"


def test_rows_around_an_equation():
    page = "              1\n    mAP =  ------ X  p      (1)\n            |C|   c=1\n\n   f(x) =               (2)\n            1   if x > 0\n            0   otherwise\n"
    got = {e["label"]: e["latex"] for e in L.equations(page)}
    assert got["2"] == "f(x) = \\begin{cases} 1 & \\text{if } x > 0 \\\\ 0 & \\text{otherwise} \\end{cases}"
    assert "\\sum_{c=1}" in got["1"] and "\\frac{1}{|C|}" in got["1"]
