import random

import pytest

from kbspark.llm.pages import MOST_PAGES, disturbed_lines, mend_pages, read_edge

WORDS = ["delivery", "warranty", "contract", "cooling", "framework", "inspection", "certificate", "department", "maintenance", "quarter", "operator", "indicator", "pressure", "customer", "specific", "allowance", "settlement", "warehouse"]


@pytest.fixture(scope="module")
def pages():
    draw = random.Random(8)
    clean = [(i, " ".join(draw.choice(WORDS) for _ in range(120)) + " customer-specific plan. in- and outputs.", "plain", None, "text", "x") for i in range(60)]
    docs, expected = list(clean), set()
    for p in range(1, 7):
        i = 1000 + p
        lines = [draw.choice(["Terms of the warehouse", "TERMS OF THE WAREHOUSE"]) if p != 3 else "Terms of tne wareh0use", ""]
        expected.add((i, 1, "running_header"))
        for k in range(8):
            words = [draw.choice(WORDS) for _ in range(6)]
            if k == 3:
                words[2] = words[2].replace("e", "c", 1) if "e" in words[2] else "warranfy"
                expected.add((i, len(lines) + 1, "misread"))
            line = " ".join(words)
            if k == 5:
                line += " maint-"
                expected.add((i, len(lines) + 1, "split_word"))
            if k == 6:
                line = "enance " + line + " customer-"
            if k == 7:
                line = "specific " + line + ", in-"
            lines.append(line)
        lines.append("and outputs " + " ".join(draw.choice(WORDS) for _ in range(4)))
        if p < 6:
            lines[-1] += " frame-"
            expected.add((i, len(lines), "split_word"))
        if p > 1:
            lines[2] = "work " + lines[2]
        lines += ["", ["- 4 -", "- 5 -", "- 6 -", "- 7 -", "- 8 -", "- l1 -"][p - 1] if p < 6 else "- 9 -"]
        expected.add((i, len(lines), "page_number"))
        docs.append((i, "\n".join(lines), "scan.pdf", p, "page", "x"))
    docs += [(None, "12", "scan.pdf", 1, "page", "x"), (2000, None, "scan.pdf", 9, "page", "x"), (2001, "", "other.pdf", 1, "page", "x"), (2002, "delivery warranty\n12\ncontract", None, None, "page", "x")]
    return docs, expected


SCHEMA = "doc_id long, text string, source string, physical_page int, doc_type string, line string"


def test_disturbed_lines(spark, pages):
    docs, expected = pages
    df = spark.createDataFrame([*docs, docs[62]], SCHEMA).repartition(3)
    found = disturbed_lines(df).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert disturbed_lines(df.limit(0)).count() == 0


def test_paragraphs(spark, pages):
    docs, _ = pages
    text = " ".join(r["text"] for r in mend_pages(spark.createDataFrame(docs, SCHEMA)).orderBy("source", "page", "place").collect())
    assert "maintenance" in text and "framework" in text and "customer-specific" in text and "in- and outputs" in text
    assert "maint-" not in text and "warranfy" not in text and "TERMS" not in text and "- 4 -" not in text


def test_rows_of_one_page_are_kept_apart(spark):
    docs = [(1, "alpha beta gamma", "f", 1, "page", "x"), (2, "delta epsilon zeta", "f", 1, "page", "x"), (3, "eta theta.", "f", 2, "page", "x"), (4, "iota kappa", None, 1, "page", "x"), (5, "lambda mu", None, 2, "page", "x")]
    found = {(r["doc_id"], r["page"], r["text"]) for r in mend_pages(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert found == {(1, 1, "alpha beta gamma eta theta."), (2, 1, "delta epsilon zeta"), (4, 1, "iota kappa"), (5, 2, "lambda mu")}


def test_a_file_without_stops_is_several_paragraphs_and_loses_nothing(spark):
    docs = [(i, f"words of page number{i} go on", "f", i, "page", "x") for i in range(10, 300)]
    found = mend_pages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert 4 <= len(found) <= 6 and max(r["text"].count("words") for r in found) <= MOST_PAGES + 1
    text = " ".join(r["text"] for r in sorted(found, key=lambda r: (r["page"], r["doc_id"])))
    assert [int(w[6:]) for w in text.split() if w.startswith("number")] == list(range(10, 300))


def test_a_line_of_a_hundred_thousand_characters(spark):
    long = "delivery warranty " * 6000
    other = long[:50_000] + "X" + long[50_001:]
    docs = [(1, f"{long}\nbody one.\nmore.\nand.", "f", 1, "page", "x"), (2, f"{other}\nbody two.\nless.\nor.", "f", 2, "page", "x"), (3, f"{long}\nbody six.\nthen.\nbut.", "f", 3, "page", "x")]
    found = {(r["doc_id"], r["line_no"]) for r in disturbed_lines(spark.createDataFrame(docs, SCHEMA)).collect() if r["kind"] == "running_header"}
    assert {(1, 1), (2, 1), (3, 1)} <= found


@pytest.mark.parametrize(("line", "number"), [("- 12 -", 12), ("p. 7", 7), ("Seite 3 von 9", 3), ("第5页 共9页", 5), ("[l4]", 14), ("     9O", 90), ("viii", 8), ("Page 3 of 9", 3), ("12 / 40", 12), ("12 units", None), ("Title   7", None), ("civil", None), ("", None)])
def test_page_numbers(line, number):
    assert read_edge(line)[0] == number
