"""What forms, names of sections and parts of a text do to the main text."""

import pytest

from drawstats.llm.html_text import main_text

SENTENCE = "A first sentence with words, and more of them."
LONG = f"{SENTENCE} " * 5
PARAGRAPH = f"<p>{LONG}</p>"


def blocks(body):
    text = main_text(f"<html><body>{body}</body></html>")
    return text.split("\n\n") if text else []


def test_a_form_around_the_page_is_no_form():
    page = f'<form action="x"><input type="hidden" name="state"><div>{PARAGRAPH}<p>{SENTENCE}</p></div></form>'
    assert blocks(page) == [LONG.strip(), SENTENCE]
    assert blocks(f"<article>{PARAGRAPH}</article><form><p>Your address will not be shown, fields are marked.</p><input><input><textarea>t</textarea><button>go</button></form>") == [LONG.strip()]
    assert blocks(f"<form><select><option>one</select><article>{PARAGRAPH}</article><input><fieldset><p>{SENTENCE}</p><input></fieldset></form>") == [LONG.strip()]


def test_comments_are_not_the_article_however_long():
    page = f'<div class="post"><p>{SENTENCE} Short.</p></div><div class="comments"><article>{PARAGRAPH * 6}</article></div>'
    assert blocks(page) == [f"{SENTENCE} Short."]
    assert blocks(f'<div id="comments">{PARAGRAPH * 2}</div>') == [LONG.strip()] * 2  # nothing else is on the page


@pytest.mark.parametrize("name", ["ad-hoc-networks", "menu-history", "banner-image", "headers-and-footers-explained"])
def test_names_of_subjects_hide_nothing(name):
    assert len(blocks(f'<article>{PARAGRAPH}<div class="{name}"><p>{SENTENCE}</p></div><section id="{name}"><p>{SENTENCE}</p></section><figure class="banner"><figcaption>{SENTENCE}</figcaption></figure></article>')) == 4


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "site-nav", "cookie-notice", "comment-list", "user-comments", "sidebar left", "js-menu", "newsletter-signup-form"])
def test_names_of_what_is_left_out(name):
    assert blocks(f'<article>{PARAGRAPH}<div class="{name}"><p>{SENTENCE}</p></div><div id="{name}">{SENTENCE}</div></article>') == [LONG.strip()]


def test_parts_of_one_text_stay_together():
    short = "<p>Short.</p>"
    assert blocks(f"<div><section>{PARAGRAPH * 2}</section><section>{short}</section><section>{short}</section></div>")[2:] == ["Short.", "Short."]
    assert blocks(f'<div><div class="part">{PARAGRAPH * 2}</div><div class="part">{short}</div><div class="other"><a href="x">Elsewhere</a></div></div>')[2:] == ["Short."]
    assert blocks(f'<div class="page widget">{PARAGRAPH * 20}</div>') == [LONG.strip()] * 20  # holds most of the text
