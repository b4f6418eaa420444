import pytest

from strataspark.llm import residue as rs

from heldout import CONTENT as OTHER
from heldout import RESIDUE

INDEX = rs.Index(1000, {})
CONTENT = "We keep CacheStore in the core package because the cycle count kept rising after the last release."
CASES = {
    "slot": [
        "# {{title}}\n\n" + CONTENT, "Hello [YOUR NAME],\n\nthe report is ready.", CONTENT + " Ask <%= owner %> for details.", "Regards, TBD (author)", "【待补充】", "Reviewed by __REVIEWER__",
        "Details are in {0}.", "[hier Titel eintragen]", "It ships with ${version} today.", "Owner: %OWNER%", "［ここに名前を入力］",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", CONTENT + "\n\nText goes here. Replace this text with your own.", "# Notes\n\nItem one\nBullet text here",
        "Osdist cram morest osdist rantim estmisu cram.", "# X\n\n123 ccc aaa ccc ccc aaa ccc 456 aaa 123 123 ccc bbb aaa bbb", "ここに本文が入ります。", CONTENT + "\n\nPlatzhaltertext, bitte ersetzen.", "Platzhaltertext, bitte ersetzen.Hier steht später der Text dieses Abschnitts. Platzhaltertext, bitte ersetzen.",
    ],
    "announcement": ["Coming soon. We are still writing this page.", CONTENT + "\n\nContent will be added here.", "内容待补充。"],
    "error": [
        "502 Bad Gateway\n\nThe server could not answer your request.\nRequest id: 007c9bc1", "ACCESS DENIED. YOU DO NOT HAVE PERMISSION TO VIEW /GRAPH ON THIS SERVER.", "Home | Docs | Search\n\nYour session has expired. Sign in again to continue.\n\nv1.2",
        "<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1><hr>edge/1.2</body></html>", '{"error": {"code": 503, "message": "service unavailable", "trace": "a1b2c3d4"}}', "Seite nicht gefunden. Die angeforderte Adresse gibt es nicht (mehr). Fehler 404",
        "Unhandled exception while rendering /api\nTypeError: cannot read field 'owner' of undefined\n    at Store.get (api.js:5:1)",
    ],
    "notice": [
        "Please enable JavaScript to view this page.", "Checking your browser before opening the dashboard... This takes about 7 seconds. JS and cookies must be on.", "<noscript>Scripts are off. Switch them on to load the app.</noscript><div id=\"main\"></div>",
        "请启用 JavaScript 后继续浏览本页。", "This viewer needs JS. Ask your administrator if it is blocked.",
    ],
    None: [
        None, "", " \n\t", "　", CONTENT, "In the report template the slot `{{owner}}` is replaced by CacheStore before the file is written.", "Usage:\n\n```\nscan --name ${NAME} <your-name>\n```",
        "const key = `${scope}.${name}`;", "See [add a module](docs/add.md) before the next release of the core package.", "We removed the lorem ipsum fixtures from the tests of CacheStore, because build times doubled.", 'The page "Please enable JavaScript" is what the crawler stored for 7 links, so CacheStore drops those by status.',
        "When the server answers `404 Not Found`, CacheStore retries 3 times and then logs the id 5f3a.\n\n" + CONTENT, "The HTML viewer of CacheStore needs JavaScript, the SVG export does not; readers without scripts get the static file.",
        "2025-01-01 WARN [api] 502 Bad Gateway, retry 3 of 5 after the cluster map was rebuilt", "x" * 200_000, "Sans mesure, il n’est pas possible de vérifier la couverture.", "由于缓存层过期，history模块需要重新构建缓存层。",
    ],
}


@pytest.mark.parametrize("reason,text", [(r, t) for r, ts in CASES.items() for t in ts])
def test_cases(reason, text):
    assert rs.judge(text, INDEX) == reason


def test_frame(spark):
    rows = [(i, t, r) for i, (r, t) in enumerate((r, t) for r, ts in CASES.items() for t in ts)]
    # contents many times over, so that the cases do not shift the weights of their own terms
    rows += [(-i, CONTENT + f" {i}", None) for i in range(1, 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, reason string")
    found = rs.residue(df).collect()
    assert {r.doc_id: r.reason for r in found} == {i: r for i, _, r in rows if r}
    assert all(0.6 <= r.coverage <= 1.0 for r in found)
    assert rs.residue(df.limit(0)).count() == 0
    assert rs.residue(spark.createDataFrame([(1, "TBD (x)"), (1, "TBD (x)"), (None, "TBD (x)")], "doc_id bigint, text string")).count() == 3


def test_frequencies_count_texts(spark):
    df = spark.createDataFrame([("page lorem lorem",), ("lorem",), (None,)], "text string")
    n, f = rs.frequencies(df, "text")
    assert n == 3 and f["lorem"] == 2 and f["\x00page"] == 1


LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)
STOCK_LATIN = [
    LOREM, CONTENT + "\n\n" + LOREM, "Tempor magna lorem velit aliqua, nostrud dolor commodo ipsum. Officia sunt ullamco pariatur, tincidunt veniam laborum elit.",
    "Curabitur pretium tincidunt lacus, nulla gravida orci a odio.",
]
NO_LATIN = ["Nous avons mis en place un index et il est lu par le cache, et non par le module.", "El módulo no guarda la lista en el índice, sino que a la vez la lee.", 'The fixture begins with "Lorem ipsum dolor sit amet" and is read by CacheStore before each test of the parser.']


@pytest.mark.parametrize("reason,text", [("filler", t) for t in STOCK_LATIN] + [(None, t) for t in NO_LATIN])
def test_stock_latin(reason, text):
    assert rs.judge(text, INDEX) == reason


OPEN_SLOTS = [
    "{owner}", "# {title}\n\n" + CONTENT, "Owner: {owner}", "Hello [Company Name],\n\nthe report is ready.", "Written for <Project Name> in spring.", "{{#if x}}" + CONTENT + "{{/if}}", "Owner is {{ a | default('b') }} today.",
    "Owner: TBD", CONTENT + "\n\nRelease date: TBD", "[Insert title](...)",
]
NO_SLOTS = [
    "The format string {owner} stays as it is, because CacheStore reads the names first.", "The TBD list of the core package was emptied after the last release.", "See [Insert a node](docs/insert.md) before the next release of the core package.",
    "The owner of the core package reviews it.", "`{owner}` and `{{#if x}}` are read by CacheStore.", "See [Company Name](docs/name.md) and [1] before the next release.", CONTENT + " {a}", "Return a List<Class Name of package> here.",
]


@pytest.mark.parametrize("reason,text", [("slot", t) for t in OPEN_SLOTS] + [(None, t) for t in NO_SLOTS])
def test_open_slots(reason, text):
    assert rs.judge(text, INDEX) == reason


def test_slots_are_decided_by_exemplars(monkeypatch):
    monkeypatch.setitem(rs.EXEMPLARS, "slot", "")
    bare = rs.Index(1000, {})
    assert [rs.judge(t, bare) for t in OPEN_SLOTS] == [None] * len(OPEN_SLOTS)


LONG = [
    "{{" + "a" * 5000 + "}}", "[Your " + "very " * 100 + "name]", "<your-" + "x" * 300 + ">", "Notes.\n\n```\ncode\n\nDear {{name}}", "~~~\nDear {{name}}", CONTENT * 3000 + "\n\nDear {{name}}",
]


@pytest.mark.parametrize("text", LONG)
def test_no_limit_of_length(text):
    assert rs.judge(text, INDEX) == "slot"


def test_closed_fences_hide_slots():
    assert rs.judge(CONTENT + "\n\n```\nDear {{name}}\n```\n", INDEX) is None
    assert rs.judge(CONTENT + "\n\n```\nDear {{name}}\n```\n\n```\nDear {{name}}", INDEX) == "slot"


RUNS = ["asdf asdf qwer asdfgh jkl", "test testing test TEST test123 test", "foo bar baz foo bar baz qux", "456 bbb bbb 123 aaa 456 ccc", "Cram morest rantim osdist estmisu."]
NO_RUNS = ["foo() calls bar(), and bar() calls baz(), which reads the cache.", "The test tests that testing the tester works.", "1 2 3 4 5 6 7", "test", "Relation diagram outside decision loader of the reader."]


@pytest.mark.parametrize("reason,text", [("filler", t) for t in RUNS] + [(None, t) for t in NO_RUNS])
def test_runs(reason, text):
    assert rs.judge(text, INDEX) == reason


@pytest.mark.parametrize("documents", [1000, 1_000_000])
def test_texts_no_exemplar_was_taken_from(documents):
    """Recall and precision beyond the texts the exemplars were written after; see the README for the figures."""
    common = {t: documents // 50 for t in rs.vocabulary() if t[0] == "\x01" or len(t) < 4}
    index = rs.Index(documents, common)
    found = [bool(rs.judge(t, index)) for ts in RESIDUE.values() for t in ts]
    assert sum(found) >= 0.75 * len(found)
    assert sum(bool(rs.judge(t, index)) for t in OTHER) <= 1


def test_a_text_without_telling_terms_is_no_case():
    """What spares most texts a closer look loses nothing: all windows looked at give the same."""
    whole = rs.Index(1000, {})
    whole.survey = lambda words: (True, True, 1, 0)
    texts = [t for ts in [*CASES.values(), *RESIDUE.values(), OTHER, RUNS, NO_RUNS, OPEN_SLOTS, NO_SLOTS] for t in ts]
    assert [rs.judge(t, whole) for t in texts] == [rs.judge(t, INDEX) for t in texts]


PAGE = "<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1></body></html>"
MARKUP = {
    "error": ["<!-- " + "made by the proxy " * 30 + "-->\n" + PAGE, " \n" * 300 + PAGE, "<head><title>404 Not Found</title></head>\n<h1>404 Not Found</h1>", "<h2>502 Bad Gateway</h2>\n<p>The server could not answer your request.</p>"],
    "slot": ["<h1>Report</h1>\n\n<p>Ask <your-name> for details.</p>", "<h1>Report</h1>\n<!-- {{title}} -->", CONTENT + " Details are in <<title>>.", "<h1>Report</h1>\n\nDetails are in <<title>>."],
    None: ["<h1>CacheStore</h1>\n\n" + CONTENT, "A page with `<h1>404 Not Found</h1>` is dropped by CacheStore before the cycle count."],
}


@pytest.mark.parametrize("reason,text", [(r, t) for r, ts in MARKUP.items() for t in ts])
def test_markup_anywhere(reason, text):
    assert rs.judge(text, INDEX) == reason
