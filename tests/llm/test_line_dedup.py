from collections import defaultdict

import pytest

from textloom.llm import line_dedup


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for doc, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")] |= {site} - {None}
                if doc is not None:
                    first[line.strip(" ")] = min(first.get(line.strip(" "), doc), doc)
    out = []
    for doc, text, _ in rows:
        kept = [x for x in (text or "").split("\n") if not (doc is not None and len(sites[x.strip(" ")]) >= least and first[x.strip(" ")] != doc)]
        n = len((text or "").split("\n"))
        out.append((doc is None, doc or 0, text if len(kept) == n else "\n".join(kept), n, n - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(documents):
    rows = [(k, f"shared line\nown {k}\n\n{'half' if k % 2 else 'other'}\n shared line ", f"s{k % 12}") for k in range(24)]
    rows += [(100, None, "s1"), (101, "", None), (102, "shared line", None), (None, "shared line\nx", "s99"), (5, rows[5][1], "s5"), (103, "near\n" * 3, "s0"), (104, "x\ry", "s0")]
    rows += [(200 + k, "near", f"n{k % 7}") for k in range(20)] + [(300 + k, "exactly", f"n{k % 8}") for k in range(20)]
    out = line_dedup.dedup_lines(documents(rows))
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == brute(rows, line_dedup.MIN_SITES)
    assert {"_hits", "score", "rank"} <= set(out.columns)


def test_only_lines_on_many_sites(documents):
    """A line that one site repeats in all its documents stays."""
    rows = [(k, "same site line", "one") for k in range(50)]
    assert {r.n_removed for r in line_dedup.dedup_lines(documents(rows)).collect()} == {0}
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_several_texts_of_one_doc_id_and_a_long_text(documents):
    """Positions belong to a text, also where its doc_id has others; a text of many removed lines keeps the rest in order."""
    rows = [(k, f"a line that all have\nown {k}", f"s{k}") for k in range(12)]
    rows += [(3, "own first\na line that all have", "s3"), (3, "nothing of it", "s3"), (3, None, "s3")]
    rows += [(50, "\n".join("a line that all have" if k % 2 else f"kept {k}" for k in range(20_000)), "s1")]
    out = line_dedup.dedup_lines(documents(rows))
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == brute(rows, line_dedup.MIN_SITES)


def test_sketches_decide_lines_far_from_the_threshold(documents, monkeypatch):
    """Without the exact counts near the threshold only lines near it can change."""
    rows = [(100 * k + j, f"line {k}", f"s{j}") for k in (2, 5, 8, 60) for j in range(k)]
    monkeypatch.setattr(line_dedup, "NEAR", -10)  # no line is near
    lost = {r.doc_id // 100 for r in line_dedup.dedup_lines(documents(rows)).where("n_removed > 0").collect()}
    assert 60 in lost and not lost & {2, 5}


def test_columns_with_the_names_of_the_counts_are_an_error(documents):
    table = documents([(1, "a\nb", "s")])
    for name in ("n_lines", "N_removed"):
        with pytest.raises(ValueError, match="already"):
            line_dedup.dedup_lines(table.withColumn(name, table["doc_id"]))
    out = line_dedup.dedup_lines(table.withColumn("n_lines", table["doc_id"]), n_lines=line_dedup.fresh("n_lines", table.withColumn("n_lines", table["doc_id"]))).first()
    assert (out.n_lines, out._n_lines) == (1, 2)
