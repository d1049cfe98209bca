from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomcrawl.llm import residue, stuffing

PROSE = "The old harbour near the village was painted by sailors before the first frost, although the rain never stopped. Since then the neighbours have repaired many wooden places, among them the valley and an orchard."


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [
        ("A page", PROSE, (False, False, False)),
        ("{{ page.heading }}", PROSE, (True, False, False)),
        ("A page", "Dear {{customer}},\n" + PROSE, (True, False, False)),
        ("A page", "Posted by undefined on undefined in undefined\n" + PROSE, (True, False, False)),
        ("A page", "Click to edit this paragraph and tell visitors about your shop.\n" + PROSE, (True, False, False)),
        ("A page", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", (False, True, False)),
        ("Oops", "Error 404: Page not found\nTry the search box or come back in a few minutes.", (False, False, True)),
        ("Just a moment", "Log in · Register\nChecking your browser before you continue. This takes about 5 seconds.\n204 comments", (False, False, True)),
        ("A page", "You need to enable JavaScript to run this site.", (False, False, True)),
        ("Why we redesigned our 404 page", 'A visitor who met the words "page not found" used to leave; the team now shows a map of nearby stories. ' + PROSE, (False, False, False)),
        ("A page", PROSE + "\nSome features of this site work only with JavaScript switched on.", (False, False, False)),
        ("", "", (False, False, False)),
        (None, None, (False, False, False)),
        ("A page", "x" * 100_000, None),
    ],
)
def test_pages(title, text, want):
    got = residue.judge_pages([(title, text)])[0]
    assert want is None or got == want


@pytest.mark.parametrize("mark", ["{{ company_name }}", "{{x}}", "${user.name}", "%% city %%", "[INSERT COMPANY NAME]", "[[order_id]]", "<%= name %>", "@@name@@", "{city}", "[object Object]", "undefined"])
@pytest.mark.parametrize("times", [0, 1])
def test_part_of_a_paragraph(mark, times):
    line = f"The bridge near the village was painted by {mark} before the first frost, although the rain never stopped at all." + (" " + PROSE) * times
    assert 100 <= len(line) <= 500
    assert residue.judge_pages([("A page", line)]) == [(True, False, False)]
    assert residue.judge_pages([("A page", line.replace(mark, "sailors"))]) == [(False, False, False)]


def test_instruction_and_talk_in_a_paragraph():
    assert residue.judge_pages([("A page", f"{PROSE} Click to edit this paragraph and tell visitors about your shop. {PROSE}")]) == [(True, False, False)]
    assert residue.judge_pages([("A page", f"{PROSE} In the letter tool a field such as {{{{first_name}}}} is swapped for the reader's name. {PROSE}")]) == [(False, False, False)]


def test_windows_do_not_leave_their_line():
    alone, _ = residue.score_lines(["Error 404: Page not found"])
    among, _ = residue.score_lines(["The cat sleeps all day", "Error 404: Page not found", "It rained.", ""])
    assert abs(alone[0] - among[1]).max() < 1e-6
    assert residue.score_lines([])[0].shape == (0, 3)


def test_residue_table(spark):
    rows = [(1, "A page", PROSE), (2, "{{title}}", PROSE), (3, None, None), (4, "", ""), (None, "{{title}}", "x"), (2, "{{title}}", PROSE)]
    df = spark.createDataFrame(rows, "page_id bigint, title string, main_text string").withColumn("is_residue", F.lit("clash"))
    assert [r.page_id for r in residue.residue_pages(df).collect()] == [2]
    assert sorted(r.page_id for r in residue.clean_pages(df).collect() if r.page_id) == [1, 3, 4]
    assert residue.residue_pages(df.limit(0)).count() == 0


def pages():
    out = []
    for i in range(40):
        out.append((i, f"{PROSE} Number {i} of the stories tells what the {'abcdefgh'[i % 8] * 4} crew saw when they came back over the hill.", ["More"]))
    stuffed = "Buy tent pegs because tent pegs from the coast are tent pegs you trust. Many ask for tent pegs: tent pegs online, best tent pegs. "
    spam = {
        100: "tent pegs, cheap tent pegs, tent pegs online, buy tent pegs, tent pegs sale, best tent pegs, tent pegs review, tent pegs near me",
        101: stuffed * 4,
        102: "\n".join(f"sturdy racks {x} navy SKU{x}77 offers" for x in range(20)),
        103: " ".join(f"#tent #pegs #{x}pegs" for x in "abcdefgh"),
        104: "Sign up now\n" + "\n".join(f"{x} pegs shop" for x in ("north", "south", "east", "west", "upper", "lower")),
    }
    out += [(k, t, [x for x in t.split("\n") if "shop" in x] + ["a", "b", "c"]) for k, t in spam.items()]
    out += [(200, "", []), (201, None, None), (202, "short", []), (203, "Glossary of the workshop\n" + "\n".join(f"The {w} is a kind of tool that the sailors used when they had to mend a boat before the frost." for w in ("adze", "awl", "jig", "maul", "pin")), [])]
    return out


def test_spam_pages(shared):
    schema = "page_id bigint, main_text string, outlinks array<struct<target_url:string,anchor_text:string>>"
    rows = [(k, t, [("http://x.test/", a) for a in links] if links is not None else None) for k, t, links in pages()]
    df = shared.createDataFrame(rows + rows[:3] + rows[-6:], schema).withColumn("lang", F.lit("clash")).withColumn("n_words", F.lit("x"))
    got = sorted(r.page_id for r in stuffing.spam_pages(df).collect())
    assert got == [100, 101, 102, 103, 104]
    assert stuffing.spam_pages(df.limit(0)).count() == 0


def test_tag_list_with_one_placeholder_is_spam(shared):
    tags = pages()[:40] + [(300, "{{tag}}\n" + next(t for k, t, _ in pages() if k == 100), [])]
    schema = "page_id bigint, main_text string, outlinks array<struct<target_url:string,anchor_text:string>>"
    df = shared.createDataFrame([(k, t, [("http://x.test/", a) for a in links]) for k, t, links in tags], schema)
    assert residue.judge_pages([(None, tags[-1][1])])[0][0]
    assert [r.page_id for r in stuffing.spam_pages(df).collect()] == [300]


PLAIN = {
    "nl": "De oude haven bij het dorp werd door zeelieden geschilderd voor de eerste vorst. Sindsdien hebben de buren veel houten plekken hersteld, en niemand heeft er een woord over gezegd.",
    "it": "Il vecchio porto vicino al paese è stato dipinto dai marinai prima del gelo. Da allora i vicini hanno riparato molti luoghi di legno e nessuno ne ha parlato.",
    "pt": "O velho porto perto da aldeia foi pintado pelos marinheiros antes da primeira geada. Desde então os vizinhos consertaram muitos lugares e ninguém falou mais disso.",
    "hu": "A falu melletti régi kikötőt a tengerészek festették ki az első fagy előtt. Azóta a szomszédok sok helyet megjavítottak, és senki sem szólt róla.",
    "short": "Closed today.",
    "stub": "North pier lamp",
}


def test_prose_of_other_languages_and_short_texts_are_no_spam(shared):
    schema = "page_id bigint, main_text string, outlinks array<struct<target_url:string,anchor_text:string>>"
    spam = [(901, "zelt heringe, zelt heringe kaufen, zelt heringe billig, beste zelt heringe"), (902, "tenda picchetti, tenda picchetti prezzo, picchetti tenda, comprare tenda picchetti")]
    rows = [(k, t, []) for k, t, _ in pages()[:40]] + [(500 + k, t, []) for k, t in enumerate(PLAIN.values())] + [(k, t, []) for k, t in spam]
    got = sorted(r.page_id for r in stuffing.spam_pages(shared.createDataFrame(rows, schema)).collect())
    assert got == [901, 902]
    words = lambda t: [stuffing._WORD.findall(x.lower()) for x in t.split("\n")]
    assert [stuffing.language_of(words(PLAIN[k])) for k in ("nl", "it", "pt", "hu")] == ["nl", "it", "pt", "xx"]
    assert [stuffing.language_of(words(t)) for t in (PROSE, "Compartir esta página. No responde de los sitios")] == ["en", "es"]


def test_linked_words():
    links = {("north", "pegs"), ("north",), ("lamp",)}
    assert stuffing.linked_words("see north pegs and north lamp north pegs".split(), links) == 6
    assert stuffing.linked_words([], links) == 0


#: Written apart from the examples that the models were fitted to.
HELD_OUT = [
    "Hi {{guest.firstName}}, your table is ready.", "Kind regards, ~~CUSTOMER~~", "Order #${orderId} has shipped to ${zip}.", "Hola {{nombre}}, gracias por tu compra.", "Hallo [VORNAME], vielen Dank.",
    "Copyright <%= year %> <%= owner %>", "{% if user %}Hello{% endif %}", "By [AUTHOR NAME]", "Call us at [PHONE NUMBER] today", "Dear __RECIPIENT__,", "Total due: @@amount@@", "<YOUR COMPANY NAME HERE>", "Published on Invalid Date",
    "Showing NaN of undefined results", "Hello undefined", "Add a caption here and describe your photo.", "Replace this text with a short description of your service.",
    "HTTP 404 - The requested page could not be found", "Whoops, something went wrong.", "We couldn't find that page.", "This page isn't available right now", "403 Forbidden", "Internal Server Error", "Service Unavailable",
    "Uncaught TypeError: Cannot read properties of undefined (reading 'name')", "Please enable JavaScript to continue using this application.", "Enable cookies and reload the page", "Verifying you are human. This may take a few seconds.",
    "Lorem ipsum dolor sit amet consectetur", "Cette page est introuvable", "Die Seite wurde nicht gefunden", "No se ha encontrado la p\u00e1gina",
]
HONEST = [
    PROSE, "The museum opens at nine and the last boat leaves at five.", "Der alte Hafen liegt still, und niemand wei\u00df warum.", "Le vieux port est calme depuis que les bateaux sont partis.", "The error in the old survey was found when two maps did not agree.",
    "She did not find the page she was looking for, so she closed the book.", "His title was undefined for years, and nobody minded.", "The void contract was null and void from the start.", "We tested the new bridge for a week before it opened.",
    "Access to the island is denied to visitors in winter because the path floods.",
]


def test_recall_on_held_out_lines():
    flags = residue.judge_pages([("A page", x) for x in HELD_OUT])
    missed = [x for x, f in zip(HELD_OUT, flags) if not any(f)]
    assert len(missed) <= len(HELD_OUT) // 10, missed
    assert not any(any(f) for f in residue.judge_pages([("A page", x) for x in HONEST]))
