"""Cases of the second review: places where an operator did less than the whole job."""

import pytest

import corpus_pipeline
from llm_fixtures import tables  # noqa: F401

from tickflow.llm import op2_substring as o2
from tickflow.llm import op7_html as o7
from tickflow.llm import op9_templates as o9
from tickflow.llm.queries import QUERIES


def dropped(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return o9.recurring(df, **more).collect()


# --- 9 templates --------------------------------------------------------------------------------
def test_templates_of_frequent_values(spark):
    """Every value of both fields stands in 20 documents and more, and no combination does."""
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    rows = [(a, d, k) for a in range(30) for d in days for k in range(3)]
    name = lambda a: "N" + chr(97 + a % 26) * (a // 26 + 2)
    texts = [f"own {a} {d} {k}\nPosted by {name(a)} on {d}" for a, d, k in rows]
    texts += [f"own {i} text\nPosted by hand in {'x' * (i + 1)} without any date" for i in range(50)]
    got = [r for r in dropped(spark, texts) if r.line == 1 and r.doc_id < 630]
    assert {(r.template, r.docs) for r in got} == {("Posted by <*> on <*>", 630)} and len(got) == 629


def test_templates_of_a_repeated_corpus(spark):
    """A corpus repeated under new values drops what it dropped, and as much again each time."""

    def corpus(times):
        for k in range(times):
            for i in range(24):
                new = "v" * (k + 1) + chr(97 + i)
                yield f"a{i}b{k} \nSent with {new} by {'abc'[i % 3]} for all\nThe same line for everyone"

    least = {r.template: r.docs for r in dropped(spark, corpus(1))}
    assert least == {"Sent with <*> by <*> for all": 24, "The same line for everyone": 24}
    for times in (2, 3, 9):
        got = dropped(spark, corpus(times))
        assert {r.template: r.docs for r in got} == {t: n * times for t, n in least.items()}
        assert len(got) == 2 * (24 * times - 1)


# --- 7 pages ------------------------------------------------------------------------------------
LONG = "A sentence of the article that is long enough to be found, and it goes on for some more words."


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f()}</script>",
        "<SCRIPT type=x>if(a<b)c='</p>'</SCRIPT >",
        "<style>a<b{color:'red'}</style>",
        "<textarea>x<y and 'so on</textarea>",
        "<svg><title>x<y</title></svg>",
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_page_raw_text(raw, tag):
    html = f"<body><{tag}>{raw}<p>{LONG}</p><p>{LONG}</p>{raw}<p>{LONG}</p></{tag}></body>"
    assert o7.main_text(html) == "\n".join([LONG] * 3)
    assert o7.main_text(html + "<script>for(i=0;i<n;i++){f()} never closed > here") == "\n".join([LONG] * 3)
    assert o7.main_text(f"<head><title>1 <b or 2</title></head>{html}") == "\n".join([LONG] * 3)


@pytest.mark.parametrize("left_out", ["<div class=ad><p>Buy this.</p></div>", "<form><input><p>Name and address</p></form>",
                                      "<div class=cookie-notice>We use cookies.</div>", "<aside><p>See also</p></aside>",
                                      "<nav><a href=/>Home</a></nav>", "<script>x()</script>"])
def test_page_parts_after_left_out(left_out):
    short = "The last paragraph has sixty characters, so it is a short one"
    menu, foot = "<nav><a href=/>Menu</a></nav>", "<footer>Site</footer><p>Powered by it</p>"
    article = f"<h1>Title</h1>{left_out}<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{left_out}<p>{short}</p>"
    want = "\n".join(["Title", LONG, LONG, LONG, short])
    for tag in ("article", "div", "section", 'div class="content"'):
        name = tag.split()[0]
        assert o7.main_text(f"<body>{menu}<{tag}>{article}</{name}>{foot}</body>") == want
        assert o7.main_text(f"<body><div>{menu}<{tag}>{article}</{name}>{foot}</div></body>") == want
    assert o7.main_text(f"<body>{menu}{article}</body>") == want


@pytest.mark.parametrize("left_out", ["<div class=ad>Buy this.</div>", "<form><p>Name</p></form>", "<script>x()</script>"])
def test_page_sections_after_left_out(left_out):
    html = f"<body><div><section><p>{LONG}</p><p>{LONG}</p></section>{left_out}<section><p>Short.</p></section></div></body>"
    assert o7.main_text(html) == f"{LONG}\n{LONG}\nShort."


# --- 2 substrings -------------------------------------------------------------------------------
def test_units_with_longer_lower_case():
    """One letter whose lower case is longer changes neither the digests nor the offsets of the others."""
    passage = "The River ran fast past the Old Mill. It had done so for a Hundred years!"
    text = f"In İstanbul they say İ and more of it. {passage}"
    plain = {d: n for _, n, _, d in o2.units(passage.lower())}
    found = {d: text[s : s + n] for s, n, _, d in o2.units(text)}
    assert len(plain) == 2 and [found[d] for d in plain] == [passage[:37], passage[38:]]
    assert [d for *_, d in o2.units("In İstanbul they say İ and more of it.")] == [d for *_, d in o2.units("In İSTANBUL they say İ and more of it.")]


UNSPACED = [
    "他们去年夏天一起去了北京的颐和园。", "彼女は毎朝早く起きて公園を散歩します！", "ฉันชอบกินข้าวผัดกับเพื่อนของฉันทุกวัน",
]


@pytest.mark.parametrize("sentence", UNSPACED)
def test_units_without_blanks(spark, sentence):
    long = sentence if sentence[-1] in "。！" else sentence + "\n"
    docs = [(1, f"{sentence}"), (2, f"我们今天不出门也不想做饭。{long}天气很好大家都高兴地出门。"), (3, "另外的一段文字在这里写着。")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in o2.deduplicate(df).collect()}
    assert got[1] == docs[0][1] and got[3] == docs[2][1]
    if long == sentence:
        assert got[2] == "我们今天不出门也不想做饭。天气很好大家都高兴地出门。"
    assert [t for t in ("好。", "はい！", "短い。") if list(o2.units(t))] == []
    line = [(1, f"a\n{sentence}\nb"), (2, f"c\n{sentence}\nd")]
    got = {r.doc_id: r.text for r in o2.deduplicate(spark.createDataFrame(line, "doc_id long, text string")).collect()}
    assert got == {1: line[0][1], 2: "c\nd"}


def test_short_lines_are_units(spark):
    docs = [(1, "Some words.\nErrereen thing restat.\nNo. Yes it is."), (2, "Other words.\nErrereen thing restat.\nNo. Yes it is.")]
    got = {r.doc_id: r.text for r in o2.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "Other words.\nNo. Yes it is."}


@pytest.mark.parametrize("line", [x.strip("。！") for x in UNSPACED] + ["本网站第{}页由张三制作"])
def test_templates_without_blanks(spark, line):
    rows = "零一二三四五六七八九甲乙丙丁戊己庚辛壬癸子丑寅卯"
    texts = [f"{x}的开始在这里写下一些话{x * 9}\n{line.format(i)}\n好{x}" for i, x in enumerate(rows)]
    got = [r for r in dropped(spark, texts) if r.line == 1]
    assert len(got) == len(rows) - 1 and {r.docs for r in got} == {len(rows)}
    assert {r.template.replace(" ", "") for r in got} == {line.format("<*>")}
    assert not any(r.line == 2 for r in dropped(spark, texts))


def test_templates_in_few_documents(spark):
    long, middle, short = "The whole of this footer stands under every page here", "Os arcoí con de", "a b c"
    texts = [f"own{i} text{i} line{chr(97 + i)}\n" + "\n".join(t for t, n in ((long, 5), (middle, 16), (short, 19)) if i < n) for i in range(19)]
    got = {(r.template, r.docs) for r in dropped(spark, texts, few_docs=o9.FEW_DOCS)}
    assert got == {(long, 5), (middle, 16)} and not dropped(spark, texts)
    assert not dropped(spark, texts[1:5], few_docs=o9.FEW_DOCS)


def test_templates_query_in_few_documents(spark, tables):
    docs = [(i, f"own{i} text\nThe whole of this footer stands under every page here", "en", "s", 60) for i in range(6)]
    got = QUERIES["op9_templates"](spark, tables(documents=docs)).collect()
    assert sorted((r.doc_id, r.line, r.docs) for r in got) == [(i, 1, 6) for i in range(1, 6)]


# --- the pipeline -------------------------------------------------------------------------------
def test_pipeline_cuts_short_pages(spark):
    """A page of mostly recurring lines loses them as well; one of nothing else stays whole."""
    foot = "All of the many rights in this are reserved as ever"
    docs = [(i, f"own{chr(97 + i)} words\n{foot}", "en", "s", 1) for i in range(25)] + [(90, f"{foot}\n \t", "en", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    own = {i: t.split("\n")[0] for i, t, *_ in docs}
    assert got == {i: (x, len(x)) for i, t, *_ in docs for x in [own[i] if 0 < i < 90 else t]}
