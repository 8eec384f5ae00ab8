"""Toxicity of very long texts in linear time; pages with self-closing elements and with prose beside the article."""

import time

from rowmend.llm import html, toxicity


def test_many_hits_and_exceptions_stay_linear():
    lexicon = toxicity.Lexicon({" bad": 2.0, toxicity.folded("awful"): 3.0}, [" badger ", toxicity.folded("not awful")])
    matcher = toxicity.Matcher(lexicon)

    def took(n):
        text = "badger bad not awful awful " * n
        start = time.process_time()
        weight = matcher.features(text)[0]
        assert round(2.718281828459045**weight - 1) == 5 * n
        return time.process_time() - start

    took(100)
    assert took(60_000) < 8  # 300,000 words


def test_an_exception_inside_a_longer_one():
    lexicon = toxicity.Lexicon({" b ": 1.0}, [" a b c ", " b c "])
    assert toxicity.Matcher(lexicon).features("b x b c x a b c b")[0] == toxicity.Matcher(toxicity.Lexicon({" b ": 1.0})).features("b x x b")[0]


def article(page):
    found = html.blocks(page)
    return html.text_under(found, {html.best_path(found)[0].hash})


def test_self_closing_elements_hold_nothing():
    for tag in ("svg", "math", "iframe", "canvas", "object"):
        page = f"<article><h1>T</h1><p>One.</p><{tag} class='x'/><p>Two.</p><{tag}><p>no</p></{tag}><p>Three.</p></article>"
        assert article(page) == "T\nOne.\nTwo.\nThree.", tag
    assert article("<article><p>One.</p><script src='x'/>if (a) '<p>no</p>'</script><p>Two.</p></article>") == "One.\nTwo."


def test_unclosed_raw_elements_stay_linear():
    def took(n):
        start = time.process_time()
        html.blocks("<p>Story.</p>" + "<svg>" * n)
        return time.process_time() - start

    took(100)
    assert took(40_000) < 20 * took(4_000) + 0.5


STORY = "".join(f"<p>Paragraph {i} of the story, long enough to be told from what stands beside it.</p>" for i in range(6))
TOLD = "\n".join(f"Paragraph {i} of the story, long enough to be told from what stands beside it." for i in range(6))


def test_prose_beside_the_article_stays_out():
    beside = "<div class='rail'><p>Some words of the rail.</p></div><div class='discussion'><p>I think so, too.</p></div>"
    assert article(f"<body><div class='story'>{STORY}</div>{beside}</body>") == TOLD
    other = "<div class='col'><p>Some words of a column.</p></div>"
    assert article(f"<body><div class='story'>{STORY}</div>{other}</body>") == TOLD


def test_an_article_in_parts_is_whole():
    assert article(f"<body><div class='page'><div class='head'><h1>T</h1></div><div class='text'>{STORY}</div></div></body>") == f"T\n{TOLD}"
    parts = "".join(f"<div class='{c}'><p>Part {c} is as long as all the others are, so none of them is the article.</p></div>" for c in ("a", "b", "c", "d"))
    assert article(f"<body>{parts}</body>").count("\n") == 3
