"""Operators that work row by row or group by group: chats, media, HTML, licenses, mixing, quality."""

import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from epochlens.llm import chat, common, extraction, licenses, media, mixing, quality


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def legal(roles: tuple[str, ...]) -> bool:
    body = roles[1:] if roles[:1] == ("system",) else roles
    return bool(body) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and body[-1] == "assistant"


def brute_cost(roles: list[int]) -> int:
    """Cheapest repair by trying, for every turn, all insertions, labels and merges."""
    best = {chat.START: 0}
    for role in roles:
        after: dict[int, int] = {}
        for s, c in best.items():
            for k in range(4):
                for path in itertools.product((1, 2, 3), repeat=k):
                    at, ok = s, True
                    for x in path:
                        ok &= (at, x) in chat.LEGAL
                        at = x
                    if not ok:
                        continue
                    base = c + chat.COSTS["insert"] * k
                    change = chat.COSTS["relabel" if role else "relabel_unknown"]
                    for to in (1, 2, 3):
                        if (at, to) in chat.LEGAL:
                            after[to] = min(after.get(to, 1 << 30), base + (0 if to == role else change))
                    if at:
                        after[at] = min(after.get(at, 1 << 30), base + chat.COSTS["merge"] + (0 if at == role else change))
        best = after
    return min(c + chat.ENDING[s] for s, c in best.items())


@pytest.mark.parametrize("seed", range(2))
def test_chat_cost_is_least(spark, seed):
    r = random.Random(seed)
    names = [None, "system", "user", "assistant", "tool"]
    rows, want = [], {}
    for conv in range(30):
        n = r.randint(1, 7)
        roles = [r.choice(names) for _ in range(n)]
        rows += [(conv, i, x, f"t{i}") for i, x in enumerate(roles)]
        want[conv] = brute_cost([chat.role_code(x) for x in roles])
    got = chat.format_chats(turns(spark, rows)).toPandas()
    assert got.groupby("conv_id").cost.sum().to_dict() == want
    assert all(legal(tuple(x.split(","))) for x in got.roles)


def test_chat_segments_join(spark):
    r = random.Random(5)
    roles = [r.choice(["user", "assistant", "system", "?"]) for _ in range(700)]
    got = chat.format_chats(turns(spark, [(1, i, x, f"t{i}<|end|>") for i, x in enumerate(roles)])).toPandas().sort_values("segment")
    assert list(got.segment) == [0, 1, 2] and got.cost.sum() == brute_cost([chat.role_code(x) for x in roles])
    assert legal(tuple(",".join(x for x in got.roles if x).split(",")))
    whole = "".join(got.text)
    assert whole.count("<|end|>\n") == got.n_out.sum() and whole.endswith("<|end|>\n") and all(f"t{i}<\\|end|>" in whole for i in range(700))


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = turns(spark, rows).selectExpr("*", "1 segment", "2 cost")
    got = {r["conv_id"]: [] for r in chat.format_chats(df).collect()}
    assert set(got) == {1, None}
    one = sorted((r["segment"], r["text"]) for r in chat.format_chats(df).collect() if r["conv_id"] == 1)
    assert "".join(t for _, t in one) == "<|user|>\na<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_chat_turns_without_numbers(spark, monkeypatch):
    """Very many rows without a turn, or with the same one, or without a conversation, are split, to the same cost."""
    monkeypatch.setattr(chat, "MOST_ROWS", 50)
    r = random.Random(6)
    names = ["assistant", "system", "user", "what"]
    rows = [(c, t, x, f"t{i:03d}") for c, t in ((1, None), (2, 7), (None, 3)) for i in range(230) for x in [r.choice(names)]] + [(1, 0, "user", "first"), (3, 0, "user", "q")]
    got = chat.format_chats(turns(spark, rows + rows[:100])).toPandas().sort_values(["segment", "part"])
    for c in (1, 2, None):
        own = got[got.conv_id.isna() if c is None else got.conv_id == c]
        order = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1], x[2], x[3]))
        assert own.cost.sum() == brute_cost([chat.role_code(x[2]) for x in order]) and own.n_turns.sum() == len(order) and own.part.max() == 4
        assert legal(tuple(",".join(x for x in own.roles if x).split(",")))
        whole = "".join(own.text)
        at = [whole.index(x[3]) for x in order]
        assert at == sorted(at)


def test_media_round_trip(spark):
    texts = ["", None, "a", "b" * 191, "c" * 192, "ü" * 5000, "a", "x\n" * 70000]
    docs = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"] or 0: r for r in media.media_columns(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (192 - len(data) if not data else -len(data) % 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.encode_png(payload)
        header, body = stored[8:33], zlib.decompress(stored[41:-16])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert header[4:16] == b"IHDR" + (192).to_bytes(4, "big") + (len(payload) // 192).to_bytes(4, "big") and b"".join(body[k + 1 : k + 193] for k in range(0, len(body), 193)) == payload
        n, counts = len(payload), [payload.count(bytes([v])) for v in range(256)]
        mean = sum(v * c for v, c in enumerate(counts)) / n
        spread = (sum((v - mean) ** 2 * c for v, c in enumerate(counts)) / n) ** 0.5
        steps = [abs(payload[k] - payload[k - 1]) for k in range(1, n) if k % 192]
        want = {"mean": mean, "std": spread, "entropy": -sum(c / n * np.log2(c / n) for c in counts if c), "step": sum(steps) / len(steps)}
        size, *told = r["feature"].split(";")
        assert size == f"{n // 192}x192" and {k: float(v) for k, v in (x.split("=") for x in told)} == pytest.approx(want, abs=1e-3)
    assert got[2][4:] == got[6][4:]
    assert media.media_columns(docs.limit(0)).count() == 0


def test_media_member_is_read_again(tmp_path):
    calls = []

    class Flaky:
        def open_input_file(self, path):
            calls.append(path)
            outer = self

            class F:
                def read_at(self, n, at):
                    data = open(path, "rb").read()[at : at + n]
                    return b"\0" * n if len(calls) == 1 and at else data

            return F()

    png = media.encode_png(media.pad(b"hello"))
    path = tmp_path / "a.arc"
    path.write_bytes(media.MEMBER.pack(media.MARK, False, 7, 5, len(png), zlib.crc32(png)) + png)
    row, size = media.read_member(Flaky(), str(path), 0)
    assert row == (7, 5, png) and size == media.MEMBER.size + len(png) and len(calls) == 2
    path.write_bytes(path.read_bytes()[:-1])
    media._open.clear()
    with pytest.raises(ValueError):
        media.read_member(Flaky(), str(path), 0)


def test_media_partitions(spark, tmp_path, monkeypatch):
    docs = spark.range(300).selectExpr("id doc_id", "repeat(cast(id as string), 3000) text")
    path = f"file://{tmp_path}/arc"
    media.store_media(docs, path)
    parts = media.ArchiveReader(path).partitions()
    assert sum(p.members for p in parts) == 300
    (tmp_path / "arc" / "_manifest.json").rename(tmp_path / "manifest")
    key = lambda ps: sorted((p.name, p.offset, p.length, p.members) for p in ps)
    assert key(media.ArchiveReader(path).partitions()) == key(parts)
    (tmp_path / "manifest").rename(tmp_path / "arc" / "_manifest.json")
    assert sorted(r["doc_id"] for r in media.read_media(spark, path).collect()) == list(range(300))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, really, all of them, accept now.</div><div id="main-col"><article><h1>Head &amp; line</h1><p>First   paragraph, with commas,
and more text, that goes on for a while so that it scores.<p>Second &lt;one&gt; with <a href=x>a link</a>&nbsp;and more.<ul><li>item one<li>item two</ul><aside>See also</aside><script>var t="</p><p>no</p>";</script>
<div class="ad">Buy now</div><form><p>Name, mail, text</p></form><blockquote>Quoted, words.</blockquote></article><div class="sidebar"><p>Side text, with commas, and a lot more text to look good to the scorer.</p></div>
<section id="comments"><p>Great article, thanks, really, for this, I liked it a lot, all of it.</p></section></div><footer><p>&copy; 2020, all rights, reserved.</p></footer></body></html>"""


def test_html_article():
    assert extraction.extract_text(PAGE).split("\n\n") == ["Head & line", "First paragraph, with commas, and more text, that goes on for a while so that it scores.", "Second <one> with a link and more.", "item one", "item two", "Quoted, words."]


def test_html_odd(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain words"), (4, "u", "<p>a<p>b</div></b>"), (None, None, PAGE), (5, "u", "<article><p>Sh.</p></article><div class=ad>ad ad</div>"), (5, "u", "<article><p>Sh.</p></article>")]
    got = extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text")).collect()
    assert [(r["page_id"], r["text"]) for r in got if r["page_id"]] == [(1, ""), (2, ""), (3, "plain words"), (4, "a\n\nb"), (5, "Sh."), (5, "Sh.")]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extraction.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_article_tag():
    page = "<body><div class=menu><a href=1>A</a><a href=2>B</a></div><div class=content><p>One long paragraph, with commas, and with enough words to be found by the scorer.</p><p>Two.</p></div><div class=footer>End</div></body>"
    assert extraction.extract_text(page) == "One long paragraph, with commas, and with enough words to be found by the scorer.\n\nTwo."


def test_html_text_beside_the_best_container():
    p = "<p>One more paragraph, with commas, and with enough words, really, to be found by the scorer of the pages.</p>"
    for n in (2, 8, 40):
        for around in ("<body><article>{}</article></body>", "<body><div>{}</div></body>"):
            sections = "<section><div>" + p * n + "</div></section><section><div>" + p * n + "</div></section>"
            assert extraction.extract_text(around.format(sections)).count("One more") == 2 * n
        page = f"<body><div>Direct text <b>beside</b> it.<div>{p * n}</div><ul><li>one<li>two</ul>tail<table><tr><td>x<td>y</table><blockquote>Short.</blockquote><div><p>End.</p></div><div><a href=1>A</a><a href=2>B</a></div><a href=3>Next page</a></div></body>"
        got = extraction.extract_text(page).split("\n\n")
        assert got[0] == "Direct text beside it." and got[n + 1 :] == ["one", "two", "tail", "x", "y", "Short.", "End."]
    assert extraction.extract_text(f"<body><div><article>{p}</article></div><div><article>{p * 9}</article></div></body>").count("\n\n") == 9


WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def made_page(r: random.Random) -> tuple[str, str]:
    """A page with boilerplate of every kind around and inside an article, and the blocks that must come out."""
    sentence = lambda n: " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + r.choice([".", "!", ", too."])
    junk = lambda: r.choice([
        f"<nav><ul>{''.join(f'<li><a href=/{i}>{sentence(2)}</a>' for i in range(4))}</ul></nav>", f"<div class='{r.choice(['ad', 'site-footer', 'cookie-notice', 'commentList', 'social share', 'ad-300x250'])}'><p>{sentence(20)}</p></div>",
        f"<aside><p>{sentence(25)}</p></aside>", f"<script>if (a<b) document.write('<p>{sentence(9)}</p>')</script>", f"<form><p>{sentence(8)}</p><input name=q></form>", f"<!-- <p>{sentence(5)}</p> -->", "<style>p > a {}</style>",
        f"<section id=comments><div><p>{sentence(30)}</p></div></section>", f"<footer>{sentence(12)}</footer>", f"<div role=navigation><a href=x>{sentence(2)}</a></div>", f"<p hidden>{sentence(20)}</p>", f"<![if x]><?php {sentence(3)} ?>",
    ])
    blocks, body = [], ""
    for _ in range(r.randint(4, 12)):
        kind = r.randrange(7)
        text = sentence(r.choice([2, 12, 40]))
        if kind < 3:
            tag = r.choice(["p", "h2", "blockquote", "pre"])
            body += f"<{tag} class='{r.choice(['', 'related-work', 'notice-board', 'lead'])}'>\n {text.replace(' ', r.choice([' ', '  ', chr(10), '&nbsp;']), 1)}</{tag}>"
            blocks.append(text)
        elif kind == 3:
            items = [sentence(3) for _ in range(3)]
            body += "<ul>" + "".join(f"<li><a href=/r>{x}</a></li>" if r.random() < 0.5 else f"<li>{x}" for x in items) + "</ul>"
            blocks += items
        elif kind == 4:
            body += f"<p>{text} <a href=z>{WORDS[0]}</a> &amp; <b>{WORDS[1]}</b> &lt;x&gt;</p>"
            blocks.append(f"{text} {WORDS[0]} & {WORDS[1]} <x>")
        elif kind == 5:
            body += f"<div><div>{text}</div><table><tr><td>{WORDS[2]}<td>{WORDS[3]}</table></div>"
            blocks += [text, WORDS[2], WORDS[3]]
        else:
            body += junk()
    whole = sentence(60)
    body += f"<p>{whole}</p>"
    blocks.append(whole)
    around = r.choice(["<article>{}</article>", "<main><div class='post has-sidebar'>{}</div></main>", "<div><article id=sidebar-story>{}</article></div>"])
    return f"<!DOCTYPE html><html><head><title>T < t</title></head><body>{junk()}{junk()}{around.format(body)}{junk()}{junk()}</body></html>", "\n\n".join(" ".join(b.split()) for b in blocks)


def test_html_made_pages():
    r = random.Random(11)
    for _ in range(400):
        page, want = made_page(r)
        assert extraction.extract_text(page) == want


def test_html_of_any_bytes():
    """No text raises, and no markup comes out of whole tags."""
    r = random.Random(12)
    bits = ["<", ">", "<!", "<![", "<!--", "-->", "]]>", "<?", "</", "<p", "<a href=", '"', "'", "&", "&#", "&#x110000;", "&amp", "<script>", "</script", "<title>", "<b", "/>", "=", " ", "x", "\0", "\ud800", "é", "<article>", "</article>", "<nav>", "<li>", "<td>", "</p>", "<br/>"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        page = list(made_page(r)[0]) if r.random() < 0.05 else []
        for _ in range(r.randint(0, 6) if page else 0):
            at = r.randrange(len(page))
            page[at : at + r.randrange(3)] = r.choice(bits)
        assert isinstance(extraction.extract_text("".join(page) + text), str)
    for page, want in {"<p>a</p><![foo[x]]>": "a", "<p>x<![ bar": "x", "<!--": "", "<!DOCTYPE [<!x": "", "<p>a</p><!-- b": "a", "<nav><ul><li>m<article><p>Text.</p></article>": "Text.", "1 < 2 && 3 > 2": "1 < 2 && 3 > 2"}.items():
        assert extraction.extract_text(page) == want


@pytest.mark.parametrize("page", ["<blockquote>x, y" * 60_000, "<i>" * 40_000 + "</u>" * 40_000, "<b>" * 30_000 + "x<div></div>" * 30_000, "<p><button>" + "<b>" * 30_000 + "<div></div>" * 30_000, "<div><a>x</a>" * 60_000,
                                  "<div><span>some text that is long enough, yes" * 20_000, "<a b='" * 150_000, "<" * 1_000_000, "<!-" * 300_000])
def test_html_takes_linear_time(page):
    began = time.process_time()
    extraction.extract_text(page)
    assert time.process_time() - began < 3


def test_license_base_places(spark):
    texts = ["GNU General-Public LICENSE; gnu general public license", "cc by by CC/BY", "mit licenses MIT License", None, "", "apache  license " * 3, "é mit license"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 labels")).collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [
        (8, 2, 0, 4, "gpl"), (5, 2, 0, 3, "cc-by"), (4, 1, 2, 2, "mit"), (0, 0, None, None, ""), (0, 0, None, None, ""), (6, 3, 0, 4, "apache"), (3, 1, 1, 1, "mit")]


def test_license_templates():
    make = licenses.compile_template
    a = make("x", "one [[maybe two]] three {{2}} four [[end]] five")
    ok = ["one three four five", "one maybe two three a four end five", "one three a b four five"]
    bad = ["one maybe three four five", "one three a b c four five", "one three four end end five", "two three four five", "one three four"]
    match = lambda t: "x" in licenses.scan_text(t.encode(), [a], [])[5]
    assert [match(t) for t in ok] == [True] * 3 and [match("so " + t + " on") for t in ok] == [True] * 3 and [match(t) for t in bad] == [False] * 5
    for markup in ("[[may]] be", "{{2}} words"):
        with pytest.raises(ValueError):
            make("x", markup)


def license_texts(r):
    """Each template with its markup settled one way or another, whole and with one mandatory word changed, and its label."""
    for label, markup in licenses.TEMPLATES.items():
        for _ in range(4):
            plain = re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if r.random() < 0.5 else "", markup)
            plain = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(f"name{k}" for k in range(r.randint(0, int(m[1])))), plain).split()
            yield label, plain, True
            at = next(i for i in r.sample(range(len(plain)), len(plain)) if not plain[i].startswith("name") and len(plain[i]) > 3)
            yield label, [*plain[:at], "otherwise", *plain[at + 1 :]], False
            yield label, plain[:-1], False


def test_license_texts_whole_and_changed(spark):
    """Against the SQL, which has the templates as regular expressions, and against what each text was made from."""
    r = random.Random(8)
    made = list(license_texts(r))
    texts = [f"x {', '.join(words).upper()}. y" for _, words, _ in made] + ["", None, "mit license " * 30, " ".join(made[0][1]) + " gnu general public license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(df).toPandas().sort_values("doc_id")
    pages = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.sql(licenses.oracle_sql("pages")).df().sort_values("doc_id")
    key = lambda d: [tuple(None if pd.isna(x) else x for x in row) for row in d[["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]].itertuples(index=False, name=None)]
    assert key(got) == key(want)
    for (label, _, whole), labels in zip(made, got.labels, strict=False):
        assert (label in labels.split(",")) == whole
    parts = [s for (label, _, whole), s in zip(made, got.score, strict=False) if label == "mit-text" and not whole]
    assert 0.75 in parts and 1.0 not in parts
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_scan_takes_linear_time():
    autos = [licenses.compile_template(k, v) for k, v in licenses.TEMPLATES.items()]
    phrases = [(f" {k} ".encode(), v) for k, v in licenses.BASE_PHRASES.items()]
    began = time.process_time()
    row = licenses.scan_text(b"mit license released under the apache license permission is hereby granted " * 20_000 + licenses._MIT.encode(), autos, phrases)
    assert row[1] == 40_000 and time.process_time() - began < 5


def mixed(spark, frame: pd.DataFrame) -> pd.DataFrame:
    schema = "doc_id long, text string, source string, size long"
    rows = [tuple(None if x is None or x != x else x for x in r) for r in frame.assign(size=7).itertuples(index=False, name=None)]
    return mixing.mix_sources(spark.createDataFrame(rows, schema)).toPandas()


def test_mix_against_sql(spark):
    r = random.Random(2)
    frame = pd.DataFrame({"doc_id": range(400), "text": ["w " * r.randint(0, 400) for _ in range(400)], "source": [r.choice(["b", "a", "é", "Z", None, "a", "a", "a"]) for _ in range(400)]})
    frame.loc[3, "text"] = None
    got = mixed(spark, frame)
    want = duckdb.sql(mixing.SQL.format(docs="frame")).df()
    key = lambda d: sorted(d[["doc_id", "size", "source_size", "target", "taken"]].round(6).itertuples(index=False, name=None))
    assert key(got) == key(want) == key(mixed(spark, frame.sample(frac=1, random_state=1)))
    src = got.merge(frame[["doc_id", "source"]], on="doc_id").fillna({"source": "~null"}).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), n=("size", "sum"), most=("source_size", "first"))
    assert (got.taken <= 2 * got["size"]).all() and (src.n == src.most).all()
    assert abs(src.target.sum() - 1.5 * src.n.sum()) < 1e-6 and ((src.taken - src.target).abs() <= 2 * mixing.BLOCK).all()


def keyed(spark, rows, columns):
    return spark.createDataFrame(rows, "s_key string, " + columns).selectExpr("false s_null", "*")


def test_mix_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 5, "e": 0}
    got = {r["s_key"]: r["target"] for r in mixing.source_targets(keyed(spark, list(sizes.items()), "source_size long")).collect()}
    weight, left, target = dict(zip("abcde", (5, 2, 1, 5, 2), strict=True)), 1.5 * sum(sizes.values()), {}
    while True:  # share, fix those above their cap, share the rest anew
        free = [s for s in sizes if s not in target]
        level = (left - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
    assert got == pytest.approx(target)


@pytest.mark.parametrize("shard_words", [20_000_000, 2_000_000, 200_000])
def test_mix_small_sources_get_their_targets(spark, monkeypatch, shard_words):
    """A source's words do not depend on the shards of the corpus."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    docs = spark.range(2000).selectExpr("id doc_id", "repeat('w ', 10000) text", "'big' source")
    for k, (n, words) in enumerate([(15, 20), (1, 300), (300, 1), (2000, 20)]):
        docs = docs.unionByName(spark.range(n).selectExpr(f"id + {10000 * (k + 1)} doc_id", f"repeat('w ', {words}) text", f"'small{k}' source"))
    got = mixing.mix_sources(docs).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    sums = sorted((r["source_size"], r["target"], r["sum(taken)"]) for r in got)
    assert sum(r[1] for r in sums) <= 1.5 * 20_040_900
    assert sums[0][:2] == (300, 600.0) and 1750 <= sums[0][2] <= 1800 and sums[1][:2] == (40000, 80000.0)
    assert all(abs(t - w) <= 0.01 * w for n, w, t in sums if n != 300)


def test_mix_odd(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", "x"), (2, None, "x"), (3, "w " * 50_000, "y")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 5 and got[got.doc_id.isna()][["size", "source_size"]].values.tolist() == [[1, 1]] and (got.taken <= 2 * got["size"]).all()
    assert spark.createDataFrame([], "doc_id long, text string, source string").transform(mixing.mix_sources).count() == 0


def test_quotas_are_highest_quotients(spark):
    r = random.Random(4)
    for low, high in ((5000, 9000), (40, 60), (0, 9000)):
        targets = [(f"s{i}", r.uniform(low, high)) for i in range(40)]
        got = {x["s_key"]: (x["unit"], x["quota"]) for x in mixing.source_quotas(keyed(spark, targets, "target double")).collect()}
        for unit in {u for u, _ in got.values()}:
            own = [t for t in targets if got[t[0]][0] == unit]
            quotients = sorted(((t / (j - 0.5), s) for s, t in own for j in range(1, 100)), reverse=True)[: int(sum(t for _, t in own) / unit + 0.5)]
            assert {s: got[s][1] for s, _ in own} == {s: sum(k == s for _, k in quotients) for s, _ in own}
            assert all(unit == mixing.BLOCK or mixing.LEAST_BLOCKS * unit * 2 > t for _, t in own)


def test_running_sums(spark):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 k").repartition(7)
    got = common.running_sums(rows, [mixing.F.col("k")], {"n": mixing.F.col("k")}).collect()
    assert len(got) == 5000 and all(r["n"] == r["k"] * (r["k"] + 1) // 2 for r in got)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels, sample=150).toPandas()
    assert len(got) == docs.count()
    used = {r[0] for r in labels.orderBy(quality.F.xxhash64("doc_id"), "doc_id").limit(150).select("doc_id").collect()}
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[~m.doc_id.isin(used)]
    assert (m.quality == 0).sum() > 20 and m[m.quality == 1].accepted.mean() >= 0.99 and m[m.quality == 0].accepted.mean() <= 0.1


def test_quality_odd(spark):
    long = "a word and another one.\n" * 50_000
    rows = [(1, None, None, None, 1.0), (2, "", "s", "en", 2.0), (None, "a b c", "s", None, 3.0), (2, "", "s", "en", 2.0), (4, long, "t", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score double").withColumnRenamed("score", "path_n")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(str, quality.keep_good(docs, none).collect())) == sorted(map(str, docs.collect()))
    one = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.quality_scores(docs, one).count() == 5
    assert quality.keep_good(docs.limit(0), none).count() == 0


def plain_sites(rows, base):
    """Host and path posteriors and final logits, document by document."""
    p = [1 / (1 + np.exp(-x)) for _, _, x in rows]
    n, total = len(rows), sum(p)
    mean = total / n
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    spread = lambda groups, about, free: (sum(len(g) * (np.mean(g) - about(k)) ** 2 for k, g in groups.items()) - free * mean * (1 - mean))
    v1 = spread(hosts, lambda k: mean, len(hosts) - 1) / (n - sum(len(g) ** 2 for g in hosts.values()) / n)
    v2 = spread(paths, lambda k: np.mean(hosts[k[0]]), len(paths) - len(hosts)) / sum(len(g) - sum(len(paths[k]) ** 2 for k in paths if k[0] == h) / len(g) for h, g in hosts.items())
    k1, k2 = (max(1.0, mean * (1 - mean) / v - 1) if v > 0 else 1e6 for v in (v1, v2))
    out = []
    for (h, q, x), own in zip(rows, p, strict=True):
        corpus = (total - own + 1 / (1 + np.exp(-base))) / n
        host = (sum(hosts[h]) - own + corpus * k1) / (len(hosts[h]) - 1 + k1)
        path = (sum(paths[h, q]) - own + host * k2) / (len(paths[h, q]) - 1 + k2)
        out.append((host, path, x - base + np.log(path / (1 - path))))
    return out


def test_site_posteriors_against_plain_sums(spark):
    r = random.Random(3)
    rate = {h: r.uniform(-3, 4) for h in "abcdefgh"}
    rows = [(h, q, rate[h] + r.gauss(0, 2) + 1.5 * "xyz".index(q)) for h in rate for q in "xyz" for _ in range(r.choice([1, 2, 5, 60]))]
    for base in (0.0, 1.2):
        scored = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, source string, lang string, __logit double")
        got = [tuple(x) for x in quality.with_sites(scored, base, "source", "lang").orderBy("i").select("__host_mean", "__path_mean", "__final").collect()]
        assert np.allclose(got, plain_sites(rows, base), atol=1e-6)


def test_sites_decide(spark):
    """The same evidence is kept on a good site and dropped on a bad one; a sparse site goes with the corpus."""
    rows = [("good", "x", 4.0)] * 300 + [("bad", "x", -4.0)] * 300 + [("mixed", "x", 4.0)] * 150 + [("mixed", "y", -4.0)] * 150
    rows += [(h, q, 0.4) for h, q in (("good", "x"), ("bad", "x"), ("mixed", "x"), ("mixed", "y"), ("new", "x"))]
    scored = spark.createDataFrame(rows, "source string, lang string, __logit double")
    got = {(x["source"], x["lang"]): x["__accepted"] for x in quality.with_sites(scored, 0.0, "source", "lang").filter("__logit = 0.4").collect()}
    assert got == {("good", "x"): True, ("bad", "x"): False, ("mixed", "x"): True, ("mixed", "y"): False, ("new", "x"): True}


def test_sites_of_urls(spark):
    urls = ["https://User:pw@Blog.Example.com:8080/en/12?x=1", "http://a.b", "no url", None, "http://a.b/#top"]
    host, path = quality.url_site(quality.F.col("url"))
    assert [tuple(x) for x in spark.createDataFrame([(u,) for u in urls], "url string").select(host, path).collect()] == [("blog.example.com", "en"), ("a.b", ""), ("", ""), (None, None), ("a.b", "")]
