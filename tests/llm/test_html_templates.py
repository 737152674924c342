"""Pages of templates that the training generator does not make, with the blocks that an extraction should keep."""

from spanweave.llm import html_tree as H

LOREM = "The river rose by two metres in the night and the lower streets of the old town were under water when the bakers came to work."
MORE = "Nobody was hurt, the mayor said, but the bridge will stay closed until engineers have looked at its piers, which may take a week."
THIRD = "Farmers further up the valley moved their cattle to the hills in time, as they had been warned by a call from the weather office."
LINKS = "".join(f'<li><a href="/{x}">{x.title()}</a></li>' for x in ("home", "world", "sport", "culture", "weather", "shop"))

#: (page, blocks to keep)
TEMPLATES = [
    # a blog with a theme's nested wrappers and widgets
    (f"""<html><head><title>x</title></head><body class="home page-template-default"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><h1 class="site-title">
    <a href="/">My blog</a></h1><nav class="main-navigation"><ul>{LINKS}</ul></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main class="site-main">
    <article class="post type-post hentry"><h2 class="entry-title">High water</h2><div class="entry-content"><p>{LOREM}</p><p>{MORE}</p><blockquote><p>{THIRD}</p></blockquote></div></article>
    <div id="comments" class="comments-area"><h3>2 thoughts</h3><ol class="comment-list"><li class="comment"><p>I live there and it was worse than you say.</p></li></ol></div></main></div>
    <div id="secondary" class="widget-area"><aside class="widget"><h3>Recent posts</h3><ul>{LINKS}</ul></aside></div></div><footer id="colophon" class="site-footer"><p>Proudly made with a theme</p></footer></div></body></html>""",
     ["High water", LOREM, MORE, THIRD]),
    # a news site: BEM names, an advert between paragraphs, related links, a newsletter box
    (f"""<body><div class="c-topbar"><a href="/">News</a><a href="/l">Log in</a></div><nav class="c-nav c-nav--primary"><ul>{LINKS}</ul></nav><div class="l-grid"><div class="l-grid__main"><main>
    <article class="c-article"><h1 class="c-article__headline">Town under water</h1><div class="c-article__body"><p>{LOREM}</p><div class="c-ad c-ad--inline">Advertisement: boots at half price, today only</div>
    <p>{MORE}</p><h2>Warned in time</h2><p>{THIRD}</p></div></article><div class="c-related"><h3>Read on</h3><ul>{LINKS}</ul></div></main></div><aside class="l-grid__aside"><h3>Most read</h3><ol>{LINKS}</ol></aside></div>
    <div class="c-newsletter-signup"><form><label>Get our letter</label><input><button>Yes</button></form></div><footer class="c-footer"><p>&copy; News company, all rights reserved</p></footer></body>""",
     ["Town under water", LOREM, MORE, "Warned in time", THIRD]),
    # an old page of layout tables without any class
    (f"""<html><body><table width="100%"><tr><td colspan="2"><a href="/">Home</a> <a href="/a">About</a> <a href="/m">Map</a></td></tr><tr><td width="20%"><a href="/1">One</a><br><a href="/2">Two</a><br><a href="/3">Three</a></td>
    <td><h1>The flood</h1><p>{LOREM}<p>{MORE}<p>{THIRD}</td></tr></table></body></html>""", ["The flood", LOREM, MORE, THIRD]),
    # an encyclopedia's page: a content box, a table, a list, navigation boxes
    (f"""<body><div id="mw-head"><div id="p-search" role="search"><form><input></form></div></div><div id="content" class="body" role="main"><h1 id="firstHeading">River flood</h1><div id="bodyContent"><p>{LOREM}</p>
    <table><tr><th>Year</th><th>Level</th></tr><tr><td>1954</td><td>4.1 m</td></tr></table><p>{MORE}</p><ul><li>the first flood of the century was in spring</li><li>the second one came in the autumn</li></ul></div></div>
    <div id="mw-navigation"><h2>Navigation menu</h2><ul>{LINKS}</ul></div><div id="footer" role="contentinfo"><ul><li>This page was last edited on Monday</li></ul></div></body>""",
     ["River flood", LOREM, "Year", "Level", "1954", "4.1 m", MORE, "the first flood of the century was in spring", "the second one came in the autumn"]),
    # utility classes only
    (f"""<body class="bg-white"><div class="flex p-4"><nav class="flex gap-2"><a href="/">A</a><a href="/b">B</a><a href="/c">C</a></nav></div><div role="dialog" class="fixed bottom-0"><p>This site uses cookies.</p><button>OK</button></div>
    <div class="max-w-2xl mx-auto"><h1 class="text-4xl">High water</h1><p class="mt-4">{LOREM}</p><p class="mt-4">{MORE}</p><pre class="p-2">level = 4.1</pre><p class="mt-4">{THIRD}</p></div>
    <footer class="mt-8 text-sm"><a href="/i">Imprint</a><a href="/p">Privacy</a></footer></body>""", ["High water", LOREM, MORE, "level = 4.1", THIRD]),
    # a page of a documentation tool
    (f"""<body><header class="topbar"><a href="/">Docs</a></header><div class="layout"><div class="sidebar" role="navigation"><ul>{LINKS}</ul></div><main role="main"><div class="breadcrumbs"><a href="/">Docs</a> / <a href="/a">Guide</a></div>
    <section class="content"><h1>Levels</h1><p>{LOREM}</p><h2>Second part</h2><p>{MORE}</p><pre><code>read(level)</code></pre></section><div class="pager"><a href="/p">Previous</a><a href="/n">Next</a></div></main></div></body>""",
     ["Levels", LOREM, "Second part", MORE, "read(level)"]),
]


def blocks(page):
    text = H.main_texts([page], H.trained())[0]
    return text.split("\n\n") if text else []


def errors():
    """Blocks lost, blocks kept wrongly, blocks of all pages."""
    lost = wrong = total = 0
    for page, gold in TEMPLATES:
        got, every = blocks(page), [t for t in H.Page(page).text if t]
        lost += sum(b not in got for b in gold)
        wrong += sum(b not in gold for b in got)
        total += len(every)
    return lost, wrong, total


def test_other_templates():
    """The README states this error: at most one block in twenty is judged wrongly."""
    lost, wrong, total = errors()
    assert (lost + wrong) / total <= 0.05


def test_training_labels_are_no_input():
    for value in ("12.5", "", "x", "0", "1"):
        page = TEMPLATES[0][0].replace('<p>', f'<p data-y="{value}">')
        assert blocks(page) == blocks(TEMPLATES[0][0])


def test_very_deep_and_hostile_pages():
    """Linear in the page: an eightfold page takes well under eight times eight as long."""
    import time

    def seconds(n):
        began = time.perf_counter()
        for page in ("<div>" * n + "<p>text</p>", "<div>" * n + "<li>x" * n, "<p>a</p>" + "<video>" * n + "<a <b" * n, "<!--" + "<select>" * n):
            H.main_texts([page], H.trained())
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 32 * max(seconds(2_000), 0.02)
