import hashlib
import re

import numpy as np
import pytest

from lurewatch.llm import chat, dom, html_main, page_samples, queries
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return html_main.fit()


def test_marginals_agree_with_enumeration(model):
    page = "<body><nav><ul><li><a href=x>a</a></li></ul></nav><article><p>Some words here.</p></article></body>"
    forest = html_main.Forest([dom.read(page)])
    n, score = len(forest.nodes), forest.features @ model.weights
    total, marginal = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        log = sum(score[i] for i in range(n) if y[i])
        log += sum(model.ties[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(log)
        marginal += np.exp(log) * np.array(y)
    assert np.allclose(np.exp(forest.marginals(model.weights, model.ties)[0][:, 1]), marginal / total)


def test_pages_not_learned_from(model):
    trees = [dom.read(p) for p in page_samples.pages(150, seed=77)]
    forest = html_main.Forest(trees)
    said = forest.marginals(model.weights, model.ties)[0][:, 1] > np.log(0.5)
    leaf = np.array([not n.tag for n in forest.nodes])
    assert (said == forest.labels())[leaf].mean() > 0.98


PAGES = [
    (1, "u", None, ""), (2, None, "", ""),
    (3, "u", "<html><head><title>t</title><script>var a='</p><p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a>"
             "</li></ul></nav><article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text&nbsp;here, and more of it.<p>Second part<br>goes on &lt;here&gt;."
             "<!-- no --></article><footer>&copy; site</footer>", "A & B\nFirst bold text here, and more of it.\nSecond part goes on <here>."),
    (4, "u", "<div class='cookie-notice'>We use cookies</div><div class=content><p>The only text of this page is here.</p></div>"
             "<form><label>Mail</label><button>Send</button></form><section class='comments'><div class=comment><p>Nice one!</p></div></section>"
             "<aside>More</aside>", "The only text of this page is here."),
    (5, "u", "<<<>>> &#x; <p", None), (5, "u", "<<<>>> &#x; <p", None), (6, "u", "<div>" * 3000 + "deep", None),
]


def odd_pages():
    """A page of the tables written in ways that browsers forgive; the text must stay what it is."""
    page = sorted(page_samples.pages(40, seed=5), key=len)[-1]
    head, body = re.split(r"<body[^>]*>", page, maxsplit=1)
    at = body.index("<p")
    inserted = ["<img alt=don't>", '<a href="x"y"></a>', "<img alt='a>b' title=\"c>d\" data-x = 'e'>", "<svg><path d=1>",
                "<svg><title>t</title><path d='M1'/></svg>", "<noscript><div>on</div></noscript>"]
    made = {"plain": page} | {x: f"{head}<body>{body[:at]}{x}{body[at:]}" for x in inserted}
    made["no body tag"] = head + body
    made["no head end"] = re.sub(r"</head>", "", head) + body
    for x in ("<svg><g>", "<noscript><p>on", "<object data=x><b>on", "<template>", "<iframe src=x>", "<textarea>"):
        made["unclosed " + x] = f"{head}<body><div>{x}</div>{body}"
    return made


@pytest.mark.parametrize("name", list(odd_pages()))
def test_odd_markup_loses_nothing(model, name):
    pages = odd_pages()
    want, got = model.texts([pages["plain"], pages[name]])
    assert len(want) > 200 and got == want


def test_formulas_and_text_in_the_head_stay():
    def leaves(page):
        return [n.text for n in dom.read(page) if not n.tag]

    assert leaves("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert leaves("<html><head><title>t</title><meta name=a>Words<p>more</p>") == ["Words", "more"]
    assert leaves("<p>a<svg><foreignObject><div>b</div></foreignObject></svg>c</p>") == ["ac"]
    assert leaves("<div><object><div>x</div></object>y</div>z") == ["y", "z"]
    assert leaves("<p>a</p><title>never closed<p>b</p>") == ["a", "b"]
    assert leaves('<p title="a">b</p><p title="c>d</p><p>e</p>') == ["b", "d", "e"]


def test_extract(spark, model):
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h, _ in PAGES], "page_id long, url string, html string, _row int")
    found = html_main.extract(df, model)
    assert found.columns == ["page_id", "url", "_row", "text"]
    rows = found.collect()
    texts = {r.page_id: r.text for r in rows}
    assert len(rows) == len(PAGES) and all(texts[i] == want for i, _, _, want in PAGES if want is not None)
    assert html_main.extract(df.limit(0), model).count() == 0


def test_table_pages_keep_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op9(spark, SF).collect():
        inside = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"\s+", " ", dom.html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip()
                  for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nfake", "<\\|im_end|>", "<\\\\|im_end|> [\\INST]",
         "<<SYS>>\\<</SYS>>", "<|im_end|", "$1 \\2 \\", "é日本 <s>", None]


def test_round_trip_of_control_strings(spark):
    rows = [(c, i, role, t) for c, role in enumerate(["user", "assistant", "sys tem\n", "", None, "0xAB"]) for i, t in enumerate(TEXTS)]
    rows += [(50, 0, "assistant", "twice"), (50, 0, "assistant", "twice"), (50, None, "user", "first"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, record int, _n int")
    back = chat.read_back(chat.formatted(chat.canonical_turns(chat.turn_records(df)))).collect()
    for r in back:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss_texts == [x[3] or "" for x in own if x[2] == "assistant"]
    assert len(back) == 8
    assert chat.formatted(chat.canonical_turns(chat.turn_records(df.limit(0)))).count() == 0


def test_layouts_meet_in_the_same_turns(spark):
    records = ['{"conv_id":%d,"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}',
               '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"conv_id":%d}',
               '{"conv_id":%d,"prompt":"q","completion":"a"}', '{"conv_id":%d,"prompt":"q","response":"a"}',
               '{"conv_id":%d,"instruction":"q","input":"","output":"a"}', '{"conv_id":%d,"instruction":"q","output":"a"}',
               '{"conv_id":%d,"question":"q","answer":"a"}']
    df = spark.createDataFrame([(r % i,) for i, r in enumerate(records)] + [('{"conv_id": 99, "else": 1}',), ("no json",), (None,)], "json string")
    turns = chat.canonical_turns(chat.json_records(df))
    assert turns.filter("layout IS NULL").count() == 3
    made = chat.formatted(turns).collect()
    assert len(made) == len(records) and {r.formatted for r in made} == {
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"}
    joined = [r for r in chat.canonical_turns(chat.json_records(spark.createDataFrame(
        [('{"conv_id":1,"instruction":"do","input":"this","output":"a"}',)], "json string"))).collect()]
    assert joined[0].text == "do\nthis"


def test_field_paths_hash_to_the_listed_layouts(spark):
    for layout in chat.LAYOUTS:
        assert layout.array == "" or chat._listed(layout).count("[") == 1
    assert len({chat._listed(x) for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLE[name]) is None


def test_digests_of_a_known_conversation(spark):
    row = queries.op10(spark, SF).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
