"""HTML extraction, token files, quality rules, merges, language identification."""

import hashlib
import random
import zlib
from array import array

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe_trie, html_extract, language_id, quality_rules, registry, token_store
from millrace.llm.chunks import PieceEncoder
from millrace.llm.common import scratch

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "\n", "a\n\nb", "a\n b", "a \nb", "x<|endoftext|>y", "x <|endoftext|> y", " it's we'll I'D",
    "日本語 テキスト  です。", "é è  　x", "1234 56a7", "don't!!! ...ok?\t\tyes", "😀😀 👍🏽 x", "a,b.c:d;e!f?g", "foo.\nBar, baz\n", "a\x1cb \x1c c",
    "\x85 a", "a b c", "ß" * 300, "aaaa" * 3000, "x " * 10, " \n \n", "word, word. \nword,\n", "ʼn ƛ ᏣᎳᎩ", "½ ² ③ 1", "a b" * 5000,
]


def odd_docs(spark, texts=ODD):
    """Repeated rows, null ids, and columns with names that the operators use themselves."""
    rows = [(i, x, "q", i, True) for i, x in enumerate(texts)] + [(3, texts[3], "q", 3, True), (None, "no id here at all", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, start long, score boolean")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# pages

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="home page"><header><h1>Site</h1><p>Tagline</p></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div id="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1><p>by someone</p></header>
<p>First <b>bold</b>
 paragraph&nbsp;of the text.<p>Short.<div class="advert">Buy now, this advert is long enough to look like text.</div><ul><li>one</li><li>two</li></ul>
<table><tr><td>a</td><td>b</td></tr></table><section class="comments"><p>Nice post, says a reader.</p></section></article>
<aside><p>Related things to read, of some length, indeed.</p></aside><form>Your name <input></form><footer>&copy; 2020</footer></body></html>"""


def test_article():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst bold paragraph of the text.\nShort.\none\ntwo\na b"


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<!-- x", ""), ("<script>x", ""), ("<p>a &am", "a &am"), ("<nav>x</nav>", ""), ("<p>&#233;&lt;b&gt;</p>", "é<b>"), ("<p " * 50, "")])
def test_broken_pages(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    "odd",
    ["<script>if (s.indexOf('<!--') >= 0) f();</script>", "<style>a { content: '<!--' }</style>", "<title>What <!-- does</title>", "<p title='<!--'></p>", "<!-- note --!>", "<!-->", "<![foo bar[x]]>", "<![ if x]>", "<![CDATA[x>", "<title>"],
)
def test_article_behind_odd_markup(odd):
    assert html_extract.main_text(f"<html><head>{odd}</head><body><article><p>The article.</p></article></body></html>") == "The article."


def test_comment_that_nothing_closes():
    assert html_extract.main_text("<p>before</p><!-- a > b <p>never shown</p>") == "before"


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<div class="share of voters">The share rose.</div>', True), ('<p class="search">We went on a search for it.</p>', True), ('<ul class="social-reforms"><li>One reform</li></ul>', True),
        ('<div class="ad-hoc committee">It met twice.</div>', True), ('<p class="alert"><a href="/x">more</a></p>', False), ('<div class="advert">Buy this now, buy it today.</div>', False),
        ('<div id="post-comments"><p>A reader wrote this long comment about it.</p></div>', False), ('<article class="comment"><p>A reader wrote this.</p></article>', False),
        ('<div class="share-buttons"><a href="/f">F</a> <a href="/t">T</a></div>', False), ('<div class="sidebarLeft">Other things</div>', False),
    ],
)
def test_words_of_classes(inside, kept):
    """A class decides on a container only if most of its words say so."""
    import re

    page = f"<body><article><p>{'The first paragraph. ' * 9}</p>{inside}<p>{'The last paragraph. ' * 9}</p></article></body>"
    lines = html_extract.main_text(page).split("\n")
    text = " ".join(re.sub("<[^>]*>", "", inside).split())
    assert (text in lines) == kept and len(lines) == 2 + kept


def test_marks_around_an_article():
    """A marked container that holds the article, or most of the content, stays."""
    words = "word " * 60
    assert html_extract.main_text(f'<div class="widget"><div class="ad">Buy now</div><article><p>{words}</p></article></div>') == words.strip()
    assert html_extract.main_text(f'<div class="widget"><p>{words}</p><p>{words}</p></div><div class="cookie-notice">We use cookies.</div>') == f"{words}\n{words.strip()}".replace(" \n", "\n")


def test_deep_nesting_is_linear():
    import time

    began = time.process_time()
    assert html_extract.main_text("<article>" + "<div>ab " * 100_000).count("\n") == 99_999
    assert html_extract.main_text("<div>" * 50_000 + "text" + "</p></b>" * 50_000) == "text"
    assert time.process_time() - began < 5


def test_ratios_smoothing_and_clusters_equal_brute_force():
    import math

    r = random.Random(2)
    for n in (1, 2, 3, 7, 40):
        chars, tags = [r.randint(1, 300) for _ in range(n)], [r.randint(1, 9) for _ in range(n)]
        ratios = []
        for i in range(n):
            near = [(math.exp(-((i - j) ** 2) / 2), chars[j] / tags[j]) for j in range(n) if abs(i - j) <= 2]
            ratios.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        mean = math.fsum(ratios) / n
        limit = min(mean, math.sqrt(math.fsum((x - mean) ** 2 for x in ratios) / n))
        assert all(abs(x - limit) < 1e-9 or (x >= limit) == c for x, c in zip(ratios, html_extract.clusters(chars, tags)))


def test_flat_page_without_article():
    words = "word " * 40
    page = f"<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div class=wrap><div class=content><h2>Head</h2><p>{words}</p><p>{words}</p><p>end</p></div><div class=sidebar><p>side text</p></div></div></body>"
    assert html_extract.main_text(page) == "\n".join(["Head", words.strip(), words.strip(), "end"])


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "<p>" + "long " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = html_extract.extracted(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 65, 65, 249_999] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extracted(df.limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(registry.default_tokenizer())
    return t, lambda x: t.encode(x or "", add_special_tokens=False).ids


def raw(ids):
    return array("I", ids).tobytes()


def test_token_files(spark, reference):
    docs = odd_docs(spark)
    got = token_store.encode_and_digest(docs, registry.default_tokenizer(), 2).collect()
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got)
    assert len(rows) == len(ODD) + 2
    start = 0
    for (i, text), (doc, at, n, crc) in zip(sorted([(k, x) for k, x in enumerate(ODD)] + [(3, ODD[3]), (-1, "no id here at all")], key=lambda x: x[0]), sorted(rows, key=lambda r: r[1])):
        ids = reference[1](text) + [2]
        assert (doc, at, n, crc) == (i, start, len(ids), zlib.crc32(raw(ids)))
        start += n
    assert token_store.encode_and_digest(empty_docs(spark), registry.default_tokenizer()).count() == 0


def test_token_files_are_selective(spark):
    path = scratch(spark, "tokens-test")
    token_store.write_tokens(odd_docs(spark), path, registry.default_tokenizer())
    plan = token_store.read_tokens(spark, path, "doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    import pyarrow.parquet as pq

    files = [f for f in (path + "/" + x for x in __import__("os").listdir(path)) if f.endswith(".parquet")]
    meta = [pq.ParquetFile(f).metadata for f in files]
    columns = [m.row_group(0).column(k) for m in meta if m.num_row_groups for k in range(m.num_columns)]
    assert any("DELTA_BINARY_PACKED" in c.encodings or "RLE_DICTIONARY" in c.encodings for c in columns if c.path_in_schema == "part_start")
    assert any("RLE_DICTIONARY" in c.encodings for c in columns if c.path_in_schema.startswith("ids"))
    assert all(c.has_column_index and c.has_offset_index for c in columns)


def test_merges_equal_the_library(spark, reference):
    r = random.Random(3)
    alphabet = " \n\t.,'sab1é 日<|endoftext|>😀"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(300)]
    got = {x["doc_id"]: x for x in bpe_trie.encode_decode(odd_docs(spark, texts), registry.default_tokenizer()).collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids"] == reference[1](text), text
        assert got[i]["decoded"] == reference[0].decode(reference[1](text), skip_special_tokens=False) == (text or "")
    d = {x["doc_id"]: x for x in bpe_trie.encode_decode_digests(odd_docs(spark), registry.default_tokenizer()).collect()}
    assert all(d[i]["ids_sha256"] == hashlib.sha256(raw(reference[1](x))).hexdigest() and d[i]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest() for i, x in enumerate(ODD))
    assert bpe_trie.encode_decode(empty_docs(spark), registry.default_tokenizer()).count() == 0


@pytest.mark.parametrize("encode_many", [lambda path: token_store.library_encoder(path).encode_many, lambda path: bpe_trie.trie_encoder(path)[1].encode_many])
def test_remembered_parts_turn_over(reference, encode_many):
    """Batches of texts through an encoder that remembers 40 parts."""
    r, encoder = random.Random(5), PieceEncoder(encode_many(registry.default_tokenizer()), bound=40)
    atoms = [*"abé. ,;!?\n\t\x01\x85'", " ", " ", "\r\n", "<|endoftext|>", " the", "ing", "日本", "Ġ", "a" * 70, "\x00", "3.14"]
    for size in [1, 2, 20, 20] * 40:
        texts = [r.choice([None, ""]) if r.random() < 0.05 else "".join(r.choices(atoms, k=r.choice([1, 2, 5, 30]))) for _ in range(size)]
        ids, n = encoder.encode(pa.array(texts, pa.string()))
        want = [reference[1](x) for x in texts]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x], texts
        assert encoder.known.young.num_rows + encoder.known.old.num_rows < 2000
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]


def test_bytes_that_are_no_text(reference):
    bpe = bpe_trie.TrieBPE(registry.default_tokenizer())
    half = raw([bpe.id_of[b"\xe6"], bpe.id_of[b"a"]])
    assert bpe.decode(half).decode() == reference[0].decode([bpe.id_of[b"\xe6"], bpe.id_of[b"a"]], skip_special_tokens=False)


# rules


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    r = random.Random(1)
    texts = [x for x in ODD if not x or len(x) < 5000] + [" ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) for _ in range(40)] + ["a b c d e\n" * 6, "#*# " * 20, "same line\n" * 9, "x" * 300]
    got = {x["doc_id"]: x for x in quality_rules.verdicts(odd_docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        n, c, s, d, w = brute_rules(text)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (n, c, s, d, w), text
        assert got[i]["base_failed"] == (n < 10 or 100 * w > 20 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.verdicts(empty_docs(spark)).count() == 0


def test_ablations(spark):
    texts = ["# # # #", "good words that are plain and simple enough to pass each rule here", "* " * 30 + "a", ""]
    rows = quality_rules.ledger(odd_docs(spark, texts + ["few"]))
    ledger = [x["fail_bits"] for x in rows.collect()]
    for x in quality_rules.ablations(rows).collect():
        bit = {r.name: 1 << r.bit for r in quality_rules.rules()}[x["rule"]]
        m = quality_rules.mask(quality_rules.POLICIES[x["version"]])
        assert x["kept"] == sum(b & m == 0 for b in ledger) and x["kept_without"] == sum(b & (m & ~bit) == 0 for b in ledger)
    assert quality_rules.ablations(quality_rules.ledger(empty_docs(spark))).count() == 0


# languages

WORDS = {"en": "the and of to in is that for with was on are by this from they have been which would".split(), "de": "der die und das ist nicht von mit dem sich auf für eine auch werden über noch zwischen".split(), "fr": "le la les et des une est dans pour que qui sur avec pas plus être cette leur très même".split()}


def make_texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 40))), lang))
    return out


def test_language_accuracy(spark):
    docs = spark.createDataFrame(make_texts(400, 5), "doc_id long, text string, lang string")
    away = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~away))
    got = language_id.identified(docs.withColumn("held", away), model).where("held")
    n = got.count()
    assert 90 < n < 180 and got.where("lang = lang_pred").count() / n > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def brute_model(rows):
    """Languages and, for each trigram slot, the log probability of every language."""
    import numpy as np

    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            for word in brute_slots(text):
                for g in word:
                    counts.setdefault(lang, {}).setdefault(g, 0)
                    counts[lang][g] += 1
    names = sorted(counts)
    kinds = len({g for own in counts.values() for g in own})
    log = lambda lang, g: float(np.float32(np.log((counts[lang].get(g, 0) + 0.1) / (sum(counts[lang].values()) + 0.1 * kinds))))
    return names, log


def brute_slots(text):
    """Trigram slots of each word."""
    raw = b" " + bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in text.lower().encode()) + b" "
    words, own = [], []
    for i in range(1, len(raw) - 1):
        if raw[i] != 0x20:
            if raw[i - 1] == 0x20:
                own = []
                words.append(own)
            own.append(((raw[i - 1] | raw[i] << 8 | raw[i + 1] << 16) * 2654435761 & 0xFFFFFFFF) >> 16)
    return words


def brute_language(model, text):
    """Prediction, score and language set of one text, by plain expectation-maximisation."""
    import math

    names, log = model
    words = [[sum(log(x, g) for g in w) for x in names] for w in brute_slots(text or "")]
    if not words or not names or not any(map(str.isalpha, text)):
        return "und", 0.0, []
    best_of = [max(w) for w in words]
    likely = [[math.exp(max(v - m, -60)) for v in w] for w, m in zip(words, best_of)]

    def fit(share):
        for _ in range(language_id.ROUNDS):
            parts = [[p * s for p, s in zip(w, share)] for w in likely]
            share = [sum(p[k] / sum(p) for p in parts if sum(p)) / len(words) for k in range(len(names))]
        return share, sum(math.log(max(sum(p * s for p, s in zip(w, share)), 1e-300)) + m for w, m in zip(likely, best_of))

    single = [sum(w[k] for w in words) for k in range(len(names))]
    at = single.index(max(single))
    share, value, score = [float(k == at) for k in range(len(names))], single[at], 1 / sum(math.exp(x - single[at]) for x in single)
    full, _ = fit([1 / len(names)] * len(names))
    order = sorted(range(len(names)), key=lambda k: (-full[k], k))
    for size in range(2, len(names) + 1):
        among = [full[k] + 1e-12 if k in order[:size] else 0.0 for k in range(len(names))]
        new, total = fit([x / sum(among) for x in among])
        total -= (size - 1) * (language_id.PENALTY + 0.5 * math.log(len(words)))
        if total <= value:
            break
        share, value = new, total
        score = max(share)
    return names[share.index(max(share))], min(max(score, 0), 1), sorted(names[k] for k in range(len(names)) if share[k] > 0.01)


def test_mixtures_equal_plain_em(spark):
    """Texts of one to four languages: no number of languages is left out."""
    r = random.Random(8)
    more = WORDS | {"xx": [w[::-1] + "q" for w in WORDS["de"]], "yy": ["z" + w.swapcase() for w in WORDS["fr"]]}
    rows = [(i, " ".join(r.choice(more[g]) for _ in range(30)), g) for i, g in enumerate(sorted(more) * 20)]
    texts = [" ".join(r.choice(more[g]) for g in r.sample(sorted(more), n) for _ in range(r.randint(20, 40))) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5) for _ in range(2)] + ["", None, "12", "the"]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {x["doc_id"]: x for x in language_id.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    plain, sizes = brute_model([(t, g) for _, t, g in rows]), set()
    for i, text in enumerate(texts):
        lang, score, among = brute_language(plain, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6 and sorted(got[i]["lang_set"]) == among, text
        sizes.add(len(among))
    assert sizes >= {0, 1, 2, 3, 4}


def test_many_languages(spark, monkeypatch):
    """More languages than the model has room for share slots."""
    monkeypatch.setattr(language_id, "MODEL", 1 << 17)
    r = random.Random(1)
    vocab = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(6)] for k in range(600)}
    rows = [(i, " ".join(r.choice(vocab[g]) for _ in range(12)), g) for i, g in enumerate(sorted(vocab) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.table.shape == (128, 600)
    assert language_id.identified(docs, model).where("lang_pred = lang").count() > 600


def test_mixtures_and_odd_texts(spark):
    docs = spark.createDataFrame(make_texts(400, 6), "doc_id long, text string, lang string")
    model = language_id.train(docs)
    mixed = " ".join(WORDS["en"] * 3 + WORDS["fr"] * 2)
    texts = [mixed, None, "", "123 !?", "… 😀", "日", "THE AND OF", " ".join(WORDS["de"]) * 400]
    got = {x["doc_id"]: x for x in language_id.identified(odd_docs(spark, texts), model).collect()}
    assert set(got[0]["lang_set"]) == {"en", "fr"} and got[0]["lang_pred"] == "en" and 0.4 < got[0]["score"] < 0.8
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[1]["score"] == 0
    assert got[5]["lang_pred"] in WORDS and got[6]["lang_pred"] == "en" and got[7]["lang_pred"] == "de"
    assert language_id.accepted(odd_docs(spark, texts), model).columns == ["doc_id", "text", "kept", "start"]
    none = language_id.train(empty_docs(spark))
    assert {x["lang_pred"] for x in language_id.identified(odd_docs(spark, texts), none).collect()} == {"und"}
    assert language_id.identified(empty_docs(spark), model).count() == 0
