"""Cases that earlier versions of the operators got wrong."""

import time

import pytest

from epochlens.llm import chat, extraction, media, quality

TEXTS = [f"Paragraph {i} of the story, which goes on for a while, with commas, and ends here in full." for i in range(5)]
STORY, WANT = "".join(f"<p>{t}</p>" for t in TEXTS), "\n\n".join(TEXTS)
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"
SAID = "<p>I think that this is wrong, and I want to say so, at length, to all who read it.</p><p>No, it is right, and you know it, as do all of us here, my dear friend.</p>"
THREAD = "".join(f'<li class="x"><span class="author">Bob {k}</span> <time>Monday</time><p>I think that this is wrong, and I want to say so, at length, {k}.</p><a href="#">Reply</a></li>' for k in range(3))


@pytest.mark.parametrize("html, want", [
    (f'<html><body><form id="aspnetForm"><input type=hidden>{MENU}<div id="content">{STORY}</div><label>Search the whole of this site here:</label><input></form></body></html>', WANT),
    (f'<body><form id="aspnetForm">{STORY}</form></body>', WANT),
    (f'<body><nav><div class="story">{STORY}</div></body>', WANT),
    (f'<body><div role="navigation"><div class="story">{STORY}</div></div></body>', WANT),
    (f'<article><div class="cookies">{STORY}</div></article>', WANT),
    ('<article><div class="cookies"><p>Mix the flour and the sugar, then bake the dough for ten minutes.</p></div></article>', "Mix the flour and the sugar, then bake the dough for ten minutes."),
    (f'<article><p>{TEXTS[0]}</p><div class="notice">Mind the step, it is high.</div><p>{TEXTS[1]}</p></article>', f"{TEXTS[0]}\n\nMind the step, it is high.\n\n{TEXTS[1]}"),
    (f'<body><div class="cookie-notice">{"We use cookies to make this site work, as told in our policy. " * 3}</div><article>{STORY}</article></body>', WANT),
    (f'<body><article>{STORY}<div class="notice">We use cookies. <a href=/p>Policy</a></div></article></body>', WANT),
    ('<body><div class="cookie-notice">We use cookies to make this site work and to show you adverts that you may like.</div></body>', ""),
    ("<body><form><label>Your name and the name of your company</label><input><button>Go</button></form></body>", ""),
    *[(f'<body><article>{STORY}</article><div id="{n}">{SAID}</div></body>', WANT) for n in ("disqus_thread", "usercomments", "video-comments")],
    (f"<body><article>{STORY}</article><section><h3>What people say</h3><ul>{THREAD}</ul></section></body>", WANT),
    (f'<body><article class="has-comments">{STORY}</article></body>', WANT),
])
def test_what_a_page_holds(html, want):
    assert extraction.extract_text(html) == want


@pytest.mark.parametrize("html", ["<title>a<title>" * 120_000, "<div class='notice'>x" * 60_000, "<nav><p>some text that is long enough to be held by it, yes</p>" * 20_000, f"<form>{STORY}" * 3_000, f"<ul>{THREAD}" * 2_000])
def test_html_takes_linear_time(html):
    began = time.process_time()
    extraction.extract_text(html)
    assert time.process_time() - began < 12


def test_archives_add_up(spark, tmp_path):
    path = f"file://{tmp_path}/arc"
    docs = spark.range(50).selectExpr("id as doc_id", "repeat('x', int(id)) as text")
    media.store_media(docs.filter("doc_id < 20"), path)
    media.store_media(docs.filter("doc_id >= 20"), path)
    assert sorted(r["doc_id"] for r in media.read_media(spark, path).collect()) == list(range(50))
    media.store_media(docs.limit(0), path)
    assert media.read_media(spark, path).count() == 50
    media.store_media(docs.filter("doc_id < 3"), path, mode="overwrite")
    assert sorted(r["doc_id"] for r in media.read_media(spark, path).collect()) == [0, 1, 2] and len([p for p in (tmp_path / "arc").iterdir() if p.name.startswith("_manifest-")]) == 1
    archive = next((tmp_path / "arc").glob("*.arc"))
    data = bytearray(archive.read_bytes())
    data[60] ^= 1
    archive.write_bytes(data)
    with pytest.raises(Exception, match="damaged member at"):
        media.read_media(spark, path).count()


def test_the_sample_is_bounded_by_ids(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "concat('some words here ', id % 7) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x.shape[0], len(y))) or quality.Model([0.0] * quality.N_FEATURES, 0.0, 0.0))
    quality.train(docs, labels, sample=2)
    assert seen == [(2, 2)]


def test_chat_batches_are_bounded_by_their_text(monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 1000)
    schema = chat.pa.schema([("i", chat.pa.int64()), ("text", chat.pa.string())])
    rows = [(i, "x" * n) for i, n in enumerate([10] * 300 + [400] * 5 + [5000, 1, None or 0])]
    batches = list(chat._to_batches(iter(rows), schema))
    assert [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == rows
    assert all(b.num_rows == 1 or sum(len(x) for x in b.column(1).to_pylist()) <= 1000 for b in batches) and max(b.num_rows for b in batches) <= 256
