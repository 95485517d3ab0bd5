"""Pages whose body stands in a form."""

from tidemark.llm import html_text

BODY = "<p>the whole article stands here in one form</p><fieldset><p>and goes on</p></fieldset>"
WANT = "the whole article stands here in one form\nand goes on"


def test_a_page_in_one_form():
    page = f"<body><form id=aspnetForm><nav>menu of it</nav>{BODY}<label>your name</label><select><option>one</select><button>send</button></form></body>"
    assert html_text.extract(page) == WANT
    marked = f"<div class='with sidebar'><form>{BODY}</form></div>"
    assert html_text.extract(marked) == WANT


def test_an_article_lifts_an_outer_form():
    page = f"<form><p>search terms here</p><article>{BODY}<form><p>write a comment</p></form></article></form><p>foot</p>"
    assert html_text.extract(page).startswith("the whole article stands here in one form")
    assert "search" not in html_text.extract(page) and "comment" not in html_text.extract(page)
    assert html_text.extract(f"<form><aside><article>{BODY}</article></aside></form><p>two words</p>") == "two words"


def test_a_form_beside_a_text_is_furniture():
    assert html_text.extract("<p>text of the page</p><form><p>search</p><label>a b c d</label></form>") == "text of the page"
