import pytest
from pyspark.sql import functions as F

from textloom.functions import bibliographic as B
from textloom.functions import text as T
from textloom.operators import abstracts, forms, patterns, records, repair
from textloom.operators.records import RecordKinds


@pytest.mark.parametrize("pages, n", [("538-539", 2), ("1649-53", 5), ("12", None), ("5-4", None), ("1-3000", None), ("1-2, 5-6", None), (None, None), ("a-b", None), ("99999999999999999999-5", None)])
def test_page_count(table, pages, n):
    assert table("p string", [(pages,)]).select(B.page_count(F.col("p"))).first()[0] == n


@pytest.mark.parametrize("issn, valid", [("0378-5955", True), ("0378-5954", False), ("2434-561X", True), ("2434561X", False), ("", False), (None, False)])
def test_issn(table, issn, valid):
    assert table("i string", [(issn,)]).select(B.is_valid_issn(F.col("i"))).first()[0] is valid


SIGNALS = "work string, title string, publication_year bigint, record_type_source string, update_types array<string>, tags array<string>, page_count bigint"


@pytest.mark.parametrize("signal, kind", [
    ({"title": "Jane van Doe (1920-2001)", "publication_year": 2002}, "obituary"),
    ({"title": "Jane Doe (1920-2001)", "publication_year": 2020}, None),
    ({"title": "Madonnina 1920–2001.", "publication_year": 2001}, "obituary"),
    ({"title": "A. B. O'Hara. 1 April 1907 – 7 May 1970", "publication_year": 1971}, "obituary"),
    ({"title": "One Two Three Four Five Six Seven Eight Nine (1907-1970)", "publication_year": 1971}, None),
    ({"title": "One Two Three Four Five Six Seven Eight (1907-1970)", "publication_year": 1971}, "obituary"),
    ({"title": "The War (1907-1970)", "publication_year": 1971}, None),
    ({"title": "Policy, 2 Parts, 1907-1970", "publication_year": 1971}, None),
    ({"title": "Jane ten Doe [1907-1970]", "publication_year": 1971}, "obituary"),
    ({"title": "History of the City 1920-2001", "publication_year": 2002}, None),
    ({"title": "Editorial: why"}, "editorial"), ({"title": "EDITORIAL"}, "editorial"), ({"record_type_source": "paratext"}, "editorial"),
    ({"update_types": ["retraction"]}, "retraction"), ({"tags": ["a", "b"]}, "both"), ({"tags": ["a"]}, None), ({"page_count": 1}, "short"), ({}, None), ({"update_types": ["retraction"], "page_count": 1}, "retraction"),
])
def test_record_types(table, signal, kind):
    kinds = RecordKinds(
        {"obituary": "drop", "editorial": "drop", "retraction": "drop", "both": "drop", "short": "drop"},
        [("obituary", "late person", 5), ("editorial", "type", "paratext"), ("editorial", "title", r"^editorial\b"), ("retraction", "update", "retraction"), ("both", "all tags", ["a", "b"]), ("short", "pages", 1)],
    )
    row = tuple(signal.get(c.split()[0]) if c.split()[0] != "work" else "w" for c in SIGNALS.split(", "))
    assert table(SIGNALS, [row]).select(records.decide_record_types(kinds)).first()[0] == kind
    for actions, rules in (({"x": "burn"}, []), ({"x": "drop"}, [("y", "tag", "t")]), ({"x": "drop"}, [("x", "smell", 1)])):
        with pytest.raises(ValueError):
            RecordKinds(actions, rules)


def test_actions(table):
    kinds = RecordKinds({"a": "drop", "b": "flag", "c": "keep"}, [])
    rows = [("a", [], None), ("a", [], "old"), ("b", ["f"], None), ("c", [], None), (None, [], None)]
    out = records.apply_record_types(table("t string, flags array<string>, dropped_reason string", rows), "t", kinds).collect()
    assert [(r.flags, r.dropped_reason) for r in out] == [([], "a"), ([], "old"), (["f", "b"], None), ([], None), ([], None)]


def test_metadata_rows(spark, table):
    from textloom import schemas

    record = '{"id":"W1","doi":"https://doi.org/10.1/AB","ids":{"pmid":"https://pubmed/12"},"publication_date":"2020-02-30","primary_location":{"source":{"issn":["0378-5955","bad"]}},"extra":1}'
    metadata = table("v string", [(record,), ('{"id":"W2","missing":true}',)]).select(F.from_json("v", schemas.METADATA).alias("r")).select("r.*")
    out = {r.work_id: r for r in B.openalex_works(metadata, table("id string, doi string", [("W2", None)])).collect()}
    assert (out["W1"].doi, out["W1"].pmid, out["W1"].issns, out["W1"].publication_year) == ("10.1/ab", "12", ["0378-5955"], None)
    assert out["W2"].is_missing is True and out["W2"].issns == [] and out["W2"].doi is None and len(out["W1"]) == 16
    cross = table("v string", [('{"work_id":"W1","title":["T"],"relation":"{\\"b\\":1,\\"a\\":2}","update-to":[{"type":"x"},{"type":"x"}],"published":{"date-parts":[[2001,2]]},"page":"1-5"}',)])
    row = B.crossref_works(cross.select(F.from_json("v", schemas.CROSSREF).alias("r")).select("r.*"), repair.column(repair.markup_text)).first()
    assert (row.title, row.relation_types, row.update_types, row.published_year, row.page_count, row.has_text_mining_licence) == ("T", ["a", "b"], ["x"], 2001, 5, False)
    assert len(row) == 20 and row.is_updated is False and row.licence_urls == row.text_mining_links == []
    pub = table("v string", [('{"work_id":"W1","abstract":[{"label":"AIM","text":"one"},{"label":"","text":"two"}],"mesh_headings":[{"descriptor":"d","is_major":true},{"descriptor":"e","is_major":false}],"title":""}',)])
    row = B.pubmed_works(pub.select(F.from_json("v", schemas.PUBMED).alias("r")).select("r.*")).first()
    assert (row.abstract, row.mesh_major_descriptors, row.mesh_descriptors, row.title, row.is_structured_abstract) == ("AIM: one two", ["d"], ["d", "e"], None, True) and len(row) == 19


def test_inverted_index(table):
    assert table("j string", [('{"the":[0,2],"end":[3],"of":[1]}',)]).select(T.from_inverted_index(F.col("j"))).first()[0] == "the of the end"


def test_count_forms_overlap(table):
    counts = forms.count_forms(table("text string", [("a a a, b-c",), ("A b",), (None,)]), table("form string", [("a a",), ("a",), ("a b",), ("b-c",), ("zz",)]))
    assert {r.form: r.n for r in counts.collect()} == {"a a": 2, "a": 4, "a b": 1, "b-c": 1, "zz": 0}


def test_glued_words(table):
    texts = table("work int, text string", [(1, "editorsThis is. This one. editors this editors this"), (2, "This A. This b. proposaI McDonald")])
    out = {r.word: r for r in forms.decide_glued_splits(forms.count_glued_words(texts, "work"), 2, 1, 3, 2, []).collect()}
    assert (out["editorsThis"].joined, out["editorsThis"].apart, out["editorsThis"].split, out["editorsThis"].reason) == (1, 2, True, "apart")
    assert out["proposaI"].split is False and "McDonald" in out


def test_split_words(table):
    text = "information " * 20 + "infor mation infor- mation in formation the of"
    out = {(r.left, r.right): r for r in forms.decide_split_joins(forms.count_split_words(table("text string", [(text,)]), table("word string", [("in",), ("formation",)]), 2), 2, 5, []).collect()}
    assert set(out) == {("infor", "mation")}
    assert out["infor", "mation"].join and (out["infor", "mation"].space, out["infor", "mation"].hyphen_space) == (1, 1)


@pytest.mark.parametrize("raw, text", [
    ("one end.Then more", "one end. Then more"), ('he said "no."Later on', 'he said "no." Later on'), ("done.“Yes” he said", "done. “Yes” he said"), ("version 2.5 and e.g.This", "version 2.5 and e.g. This"), ("the N.A.T.O.Pact", "the N.A.T.O.Pact"),
    ("red,green and blue", "red, green and blue"), ("f(x,y)", "f(x,y)"), ("O,O-diethyl", "O,O-diethyl"), ("1,000", "1,000"),
    ("cats;dogs", "cats; dogs"), ("(Smith);next", "(Smith); next"), ("Aims:We ask", "Aims: We ask"), ("day:night", "day:night"), ("x:Yz", "x:Yz"),
    ("this , that ; and : so .", "this, that; and: so."), ("wait . . . what", "wait . . . what"), ("p = .05", "p = .05"), ("odds 3 : 4", "odds 3 : 4"), ("at 3 : yes", "at 3: yes"), ("[ see p. 4 ]", "[see p. 4]"), ("( - )", "( - )"), ("really ?", "really ?"), ("so ) . Next", "so). Next"),
    ("go to www.Some.Site.org now", "go to www.Some.Site.org now"), ("(www.some-site.org).The next", "(www.some-site.org). The next"), ("me@Host.Some.Edu", "me@Host.Some.Edu"), ("doi:10.1234/Abc.Def-2", "doi:10.1234/Abc.Def-2"), ("https://x.y/Ab.Cd;e/f", "https://x.y/Ab.Cd;e/f"),
    ("Kant&rsquo;s", "Kant’s"), ("Kantrsquo;s", "Kant’s"), ("&dquo;a&dquo;", '"a"'), ("R&amp;D &#65;&#x42;", "R&D AB"), ("&nosuch;Name", "&nosuch;Name"), ("a & b;C", "a & b; C"), ("&amp;ldquo;", "&“"),
    ("exam­ ple", "example"), ("a\u200bb\ufffdc", "a b c"), ("\ufeffx\x07y", "xy"), ("eﬃcient", "efficient"), ("x\\ny", "x y"), ("co‐op co‑op", "co-op co-op"), ("  a \t\n b ", "a b"), ("", ""),
])
def test_repair(raw, text):
    assert repair.repair_text(raw) == text


def test_repair_columns(table):
    df = table("t string", [("<title>no</title><p>A&amp;B <b>c</b></p>",), (None,)])
    assert [r[0] for r in df.select(repair.column(repair.markup_text)(F.col("t"))).collect()] == ["A&B c", None]
    joined = table("t string", [("the infor mation infor-mation of www.infor mation",)]).select(repair.join_broken_words({("infor", "mation")}, set())(F.col("t"))).first()[0]
    assert joined == "the information infor-mation of www.information"
    assert table("t string", [("editorsThis www.editorsThis.com",)]).select(repair.replace_words({"editorsThis": "editors This"})(F.col("t"))).first()[0] == "editors This www.editorsThis.com"
    et_al = table("t string", [("by Etal et al. and et al so",)]).select(repair.join_broken_words({("et", "al")}, set())(F.col("t"))).first()[0]
    assert et_al == "by Etal et al. and etal so"
    assert repair.fold("Naïve–Œ") == "naive-œ"


def test_unclosed_references_stay_where_asked():
    """A reference without its semicolon is decoded as browsers do, or stays as the SQL of the query leaves it."""
    html = "<h1>of.&amp;&amp;&amp</h1><p>&ampx &#38 R&D &quot;q&quot; &copy; 1</p>"
    assert repair.markup_text(html, False) == "of.&&&amp &ampx &#38 R&D \"q\" © 1"
    assert repair.markup_text(html).startswith("of.&&& &x & R&D")


@pytest.mark.parametrize("raw, text", [
    ("Über  Models: www.a.b/c and (http://x.y) left", "uber model and left"), ("10.1234/abc the 10.5 percent", "the 10 5 percent"), ("x$$a+b$$y $c$ costs 5$", "x y costs 5"), ("vari¬ \nables well-known -- a- -b c--d", "variables well-known a b c d"),
    ("human-agents behaviour", "human-agent behavior"), ("", ""), ("awww.x.y see https://doi.org/10.1/x", "awww x y see"),
])
def test_preprocess(raw, text):
    assert repair.preprocess_text(raw, repair.TARGET_VARIANTS) == text


def test_tidy():
    assert repair.tidy_text("donâ€™t soft­en\x00  it") == "don’t soften it"
    text = "aÂ  word­s here,  Ã©tude x"
    at = text.index("here")
    new, start, end = repair.tidy_usage(text, at, at + 4)
    assert new[start:end] == "here" and new == "a words here, étude x"


SENTENCES = "array<struct<start:bigint,end:bigint,language:string>>"


def removed(table, text, spans, foreign=()):
    """Text and reason of each removal, and the labels that drop the work."""
    df = table(f"t string, s {patterns.SPAN}", [(text, spans)]).select("t", "s", T.sentence_spans(F.col("t")).alias("x"))
    tagged = F.transform("x", lambda x: x.withField("language", F.when(x["sentence"].isin(*foreign), "de").otherwise("en")) if foreign else x.withField("language", F.lit("en")))
    ranges, labels = abstracts.find_removals(F.col("s"), tagged, F.col("t"))
    row = df.select(ranges.alias("r"), labels.alias("d")).first()
    return [(text[r.start : r.end], r.reason) for r in row.r], row.d


@pytest.mark.parametrize("word", ["a", "incomprehensibilities"])
@pytest.mark.parametrize("before", [29, 30])
def test_scopes_by_words_before(table, word, before):
    """Long words or short ones: a match drops the work while fewer than thirty words come before it."""
    text = " ".join([word] * (before - 1)) + " end. Copyright here it is. More."
    at = text.index("Copyright")
    got = removed(table, text, [(at, at + 9, "copyright", "abstract_or_sentence")])
    assert got == (([("Copyright here it is.", "copyright")], []) if before == 30 else ([("Copyright", "copyright")], ["copyright"]))


def test_scopes_and_foreign_sentences(table):
    text = "One is here. Zwei ist da. Three (c) 2001 by X. Four."
    at = text.index("(c)")
    spans = [(0, 3, "word", "tokens"), (at, at + 8, "notice", "rest_of_sentence"), (at + 4, at + 8, "notice", "tokens"), (at, at + 3, "sign", "abstract")]
    got = removed(table, text, spans, ("Zwei ist da.",))
    assert got == ([("One", "word"), ("Zwei ist da.", "not_english"), ("(c)", "sign"), ("(c) 2001 by X.", "notice")], ["sign"])


def test_clean_abstract_reasons_in_order(table):
    long = "word " * 151
    rows = [
        ("mojibake", "Ã© and more", "short", [], []),
        ("label", "x", "Notice of retraction here and some more words.", [(0, 6, "notice", "abstract")], []),
        ("english", "x", "Das ist ein Satz mit acht Worten hier. Two words.", [], [(0, 38)]),
        ("short", "x", "Only three words.", [], []),
        ("kept", "x", "Here are more than five words in one sentence.", [], []),
        ("malformed", "x", long + "end.", [], []),
    ]
    data = [(k, raw, t, spans, [(a, b, "de") for a, b in foreign] + ([(39, 49, "en")] if foreign else [(0, len(t), "en")])) for k, raw, t, spans, foreign in rows]
    df = table(f"k string, raw string, text string, spans {patterns.SPAN}, sentences {SENTENCES}", data)
    out = {r.k: (r.dropped_reason, r.flags) for r in abstracts.clean_abstracts(df, 10).collect()}
    assert out == {"mojibake": ("mojibake", []), "label": ("notice", []), "english": ("not_english", []), "short": ("too_short", []), "kept": (None, []), "malformed": (None, ["malformed"])}


def test_clean_cell_rules_in_order(table):
    good = "this is the text of a work that we have written for the test"
    rows = [
        (1, ["a"], "Letter from A to B about things that are in the world"), (2, ["a"], "Volume 3, Issue 2, some title, pages 120-123"), (3, ["a"], "Export citation of the page and more of it"),
        (4, ["a"], "too short © 2019 by the Press and its many friends"), (5, ["a"], "das ist der Text und nicht das was wir den Leuten sagen"), (6, ["a", "b"], good), (7, ["a"], good.upper() + " http://x.y"), (8, ["b"], good + " one"), (9, ["b"], good + " two"), (10, ["c"], good + " three"), (11, ["d"], None),
    ]
    out = {r.k: r.dropped_reason for r in abstracts.clean_cell(table("k long, authors array<string>, text string", rows).withColumn("cell", F.lit("c")), "k", "authors", ["cell"], 0.5).collect()}
    assert {k: v for k, v in out.items() if k < 8 or k > 10} == {1: "catalogue_record", 2: "catalogue_record", 3: "web_page", 4: "empty", 5: "not_english", 6: out[6], 7: "duplicate", 11: "empty"}
    capped = [k for k, v in out.items() if v == "author_cap"]
    assert len(capped) == 1 and capped[0] in (6, 8, 9)


def test_shared_sentences_and_spam(table):
    notice = "This notice stands in very many of the texts that we have."
    prose = "The first of the {} sentences is that which we have in the text and it is not the last of them."
    rows = [(k, f"{notice} {prose.format(k)} It is number {k} of the texts in the set.") for k in range(3)] + [(10, notice), (11, "Get the best exam dumps here."), (12, "eins zwei drei " * 10), (13, "short one"), (14, None)]
    out = {r.k: (r.dropped_reason, r.clean_text) for r in abstracts.clean_shared(table("k long, text string", rows), "k", least=3).collect()}
    assert out[0] == (None, f"{prose.format(0)} It is number 0 of the texts in the set.")
    assert (out[10][0], out[11][0], out[12][0], out[13], out[14]) == ("template", "spam", "not_english", (None, "short one"), (None, None))


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_count_forms_broadcast_or_not(table, monkeypatch, limit):
    monkeypatch.setattr(forms, "BROADCAST_FORMS", limit)
    counts = forms.count_forms(table("text string", [("x y x y",), ("",), (None,)]), table("form string", [("x y",), ("y x",), ("y",)]))
    assert {r.form: r.n for r in counts.collect()} == {"x y": 2, "y x": 1, "y": 2}


def test_patterns(table):
    text = "Abstract: We write a@b.org here. Copyright 2010 by us. Done."
    df = table("t string", [(text,)]).select(F.col("t"), patterns.pattern_spans(F.col("t")).alias("s"), T.sentence_spans(F.col("t")).alias("x"))
    rows = df.select(abstracts.find_removals(F.col("s"), F.transform("x", lambda x: x.withField("language", F.lit("en"))), F.col("t"))[0].alias("r")).first().r
    assert [(text[r.start : r.end], r.reason) for r in rows] == [("Abstract:", "heading"), ("a@b.org", "contact"), ("Copyright 2010 by us.", "copyright")]
    view = patterns.token_view(table("k int, t string", [(1, "Cf. Dr. No said (e.g. This) so. Then ten")]), "k", "t").first().tokens
    assert [t.text for t in view if t.sent_start] == ["Cf", "Then"] or [t.text for t in view if t.sent_start][-1] == "Then"


def test_lower_glue_guarded_by_sure_splits(table):
    sure, guarded = {"ofthe": "of the", "inthe": "in the"}, {"amodel": ("a_word", "a model"), "tobeor": ("three", "to be or")}
    rows = [(1, "Ofthe inthe amodel tobeor www.ofthe.org"), (2, "amodel ofthe"), (3, None)]
    out = {r.k: r.o for r in table("k long, t string", rows).select("k", forms.split_lower_glue(sure, guarded, 2)(F.col("t")).alias("o")).collect()}
    assert (out[1].text, out[1].counts) == ("Of the in the a model to be or www.ofthe.org", {"two_words": 2, "a_word": 1, "three": 1})
    assert (out[2].text, out[2].counts) == ("amodel of the", {"two_words": 1}) and out[3].text is None


def test_words_of_three_parts(table):
    known = table("word string, n long", [("in", 50), ("the", 90), ("end", 9), ("then", 5)])
    out = {r.word: r.parts for r in forms.split_parts(table("word string", [("intheend",), ("inthe",), ("xyz",)]), known).collect()}
    assert out == {"intheend": ["in", "the", "end"]}
    with pytest.raises(ValueError):
        forms.split_parts(known, known, most_words=2)


@pytest.mark.parametrize("whole, scores, checked, language", [
    (0.95, [(0.9, "de"), (0.1, "en")], False, "en"), (0.5, [(0.9, "de"), (0.1, "en")], False, "de"), (0.5, [(0.9, "de"), (0.1, "en")], True, "und"), (0.5, [(0.995, "de")], True, "de"),
    (0.5, [(0.6, "en"), (0.4, "de")], True, "en"), (0.5, [(0.52, "en"), (0.48, "de")], False, "und"), (0.5, [], False, "und"), (None, [(0.0, "en")], False, "und"),
])
def test_decide_language(table, whole, scores, checked, language):
    df = table("w double, s array<struct<score:double,lang:string>>, c boolean", [(whole, scores, checked)])
    assert df.select(patterns.decide_language(F.col("w"), F.col("s"), F.col("c"))["language"]).first()[0] == language


@pytest.mark.parametrize("ranges, found", [([], True), ([(0, 4)], True), ([(0, 10)], False), (None, None)])
def test_finite_verb_outside(table, ranges, found):
    df = table("t array<struct<start:long,end:long,is_finite:boolean>>, r array<struct<start:long,end:long>>", [([(0, 3, True), (4, 5, False), (6, 9, True)], ranges)])
    assert df.select(patterns.has_finite_verb_outside(F.col("t"), F.col("r"))).first()[0] is found


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_count_forms_of_any_length(table, monkeypatch, limit):
    import random

    monkeypatch.setattr(forms, "BROADCAST_FORMS", limit)
    pick = random.Random(1)
    texts = [" ".join(pick.choices(["a", "b", "c-d"], k=n)) for n in (0, 1, 2, 7, 8, 9, 300)] + ["not there at all not there at all", None]
    wanted = sorted({" ".join(pick.choices(["a", "b", "c-d"], k=n)) for n in range(1, 9) for _ in range(12)}) + ["not there at all", "there at", "", "a  b", "x"]
    got = {r.form: r.n for r in forms.count_forms(table("text string", [(t,) for t in texts]), table("form string", [(f,) for f in wanted + wanted[:3]])).collect()}
    words = [(t or "").split() for t in texts]
    want = {f: sum(w[k : k + len(f.split(" "))] == f.split(" ") for w in words for k in range(len(w))) if f else 0 for f in wanted}
    assert got == want and got["not there at all"] == 2


def test_no_forms_and_no_texts(table):
    assert forms.count_forms(table("text string", [("a",)]), table("form string", [])).collect() == []
    assert [r.n for r in forms.count_forms(table("text string", []), table("form string", [("a b c",)])).collect()] == [0]


def test_words_are_replaced_wherever_they_stand(table):
    texts = table("k int, text string, word string", [(1, "theDog, theDog! atheDog the", "x"), (2, None, "x"), (3, "", "x"), (4, "none", "x")])
    out = forms.replace_words(texts, "k", "text", table("word string, replacement string", [("theDog", "the Dog"), ("zz", "y")])).collect()
    assert {(r.k, r.text, r.replaced) for r in out} == {(1, "the Dog, the Dog! atheDog the", 2), (2, None, 0), (3, "", 0), (4, "none", 0)}


def test_not_first_of_hot_and_null_groups(table):
    from textloom.shared import not_first

    rows = [("a", k) for k in range(50)] + [(None, 3), (None, 1), ("b", 9), ("c", None), ("c", 1)]
    out = not_first(table("g string, k int", rows), ["g"], ["k"], "later").collect()
    assert {(r.g, r.k) for r in out if not r.later} == {("a", 0), (None, 1), ("b", 9), ("c", None)} and len(out) == len(rows)


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_bigrams_are_counted_in_tasks_of_bounded_words(table, monkeypatch, most):
    """The texts of one task are dealt over as many as their words need; copies, nulls and texts of one word change nothing."""
    monkeypatch.setattr(forms, "WORDS_A_TASK", most)
    texts = table("text string", [("new york is new york",)] * 6 + [(None,), ("",), ("one",), ("York is",)]).coalesce(1)
    seen = []
    monkeypatch.setattr(forms, "dealt_finer", lambda t, n, deal=forms.dealt_finer: seen.append(deal(t, n)) or seen[-1])
    got = {(r.a, r.b): (r.n, round(r.npmi, 6)) for r in forms.bigram_npmi(texts, T.latin_words(F.col("text")), 6, 0.0).collect()}
    # 33 words: new 12, york 13, is 7
    assert got == {("new", "york"): (12, 0.920875), ("york", "is"): (7, 0.600774), ("is", "new"): (6, 0.502978)}
    parts = seen[0].select(F.spark_partition_id().alias("p")).distinct().count()
    assert seen[0].rdd.getNumPartitions() == (1 if most > 7 else 5) and (most > 7) == (parts == 1)
    assert forms.bigram_npmi(texts.limit(0), T.latin_words(F.col("text")), 1, 0.0).isEmpty()


def test_tokens_go_back_some_texts_at_a_time(monkeypatch):
    """A batch of texts makes several batches of tokens; texts without tokens and null texts keep their row."""
    import pyarrow as pa

    from textloom.operators import patterns

    monkeypatch.setattr(patterns, "TOKENS", 3)
    view = lambda t: [(x, 0, 1, x, True, False) for x in (t or "").split()]
    given = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5, 6], "text": ["a b", "c", None, "d e f g", "", "h"]})
    out = list(patterns.token_batches(view)([given]))
    assert [b["k"].to_pylist() for b in out] == [[1, 2], [3, 4], [5, 6]]
    assert [["".join(t["text"] for t in r) for r in b["tokens"].to_pylist()] for b in out] == [["ab", "c"], ["", "defg"], ["", "h"]]
