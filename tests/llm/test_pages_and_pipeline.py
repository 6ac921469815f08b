"""HTML extraction on labelled pages and odd html; the pipeline against a plain version of its stages."""

import html as entities
import re

from tests.conftest import SF
from tests.llm.test_text_operators import brute_components, brute_hits
from tidemark.llm import html, queries


def plain_article(page):
    a = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    a = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\0", a)))
    return "\n".join(t for t in (" ".join(entities.unescape(x).split()) for x in a.split("\0")) if t)


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op7_html_extraction(spark, SF).collect()
    assert len(out) == len(pages) and all(r["text"] == plain_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in out)


def test_unseen_labelled_pages():
    model = html.Model(html.labelled_pages())
    wrong = total = 0
    for page in html.labelled_pages(80, seed=99):
        nodes, labels = html.parse(page), []
        for n in nodes:
            mark = next(("".join(v) for k, *v in html._ATTRIBUTE.findall(n.attributes) if k.lower() == "label"), None)
            labels.append(int(mark) if mark else labels[n.parent] if n.parent >= 0 else 0)
        c = model.marginals(nodes)
        texts = [i for i, n in enumerate(nodes) if n.tag == "#text"]
        total += len(texts)
        wrong += sum((c[i] > 0.5) != bool(labels[i]) for i in texts)
    assert wrong / total < 0.01


def test_messages_give_exact_marginals():
    from itertools import product

    model = html.Model(html.labelled_pages(60))
    nodes = html.parse("<div class='content'><p>Some text here.</p><div class='ad'>x</div></div>")
    feature = [2.718281828459045 ** sum(model.feature.get(f, 0.0) for f in fs) for fs in html.features(nodes)]
    weight, total = [0.0] * len(nodes), 0.0
    for labels in product((0, 1), repeat=len(nodes) - 1):
        x = (0, *labels)
        w = 1.0
        for i in range(1, len(nodes)):
            p = model.edge.get(nodes[i].tag, model.edge[None])[x[nodes[i].parent]]
            w *= (p if x[i] else 1 - p) * (feature[i] if x[i] else 1)
        total += w
        for i, v in enumerate(x):
            weight[i] += w * v
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), weight, strict=True))


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<article>" * 500), (4, "u", "<!-- open"), (5, "u", "<article><p>x &lt; y &amp; z &nbsp; is it. So<br>it is.<script>if (a < b) {</p>"), (None, None, "text only"), (1, "u", None)]
    out = html.extract(spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(pages) and {r["text"] for r in out if r["page_id"] in (1, 2, 3, 4)} == {""}
    assert next(r["text"] for r in out if r["page_id"] == 5) == "x < y & z is it. So it is."


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names, stages = zip(*cp.STAGES, strict=True)
    assert len(stages) == 5 and cp.ORACLE_SQL is None
    one = cp.materialise(cp.language_id(spark, docs, SF), "t")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {i for i, t in before.items() if t and any(map(str.isalpha, t))}
    two = cp.materialise(cp.near_duplicates(spark, one, SF), "t")
    groups = brute_components([(r["doc_id"], r["text"]) for r in one.collect()], 5, 80, 100)
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == {i for i, (_, c) in groups.items() if i == c}
    three = cp.materialise(cp.repeated_passages(spark, two, SF), "t")
    assert three.columns == columns and three.count() == two.count()
    four = cp.materialise(cp.benchmark_decontamination(spark, three, SF), "t")
    clean = {x[0] for x in brute_hits([(r["doc_id"], r["text"]) for r in three.collect()], items, 10) if not x[-1]}
    assert four.columns == columns and {r["doc_id"] for r in four.collect()} == clean
    five = cp.bpe_encoding(spark, four, SF).collect()
    assert len(five) == four.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in five)
