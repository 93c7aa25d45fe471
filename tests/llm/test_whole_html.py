"""Pages whose visible text has to appear, wherever it stands."""

import random
import time

import pytest

from quillspark.llm import html_text

LOOSE = {
    "<table><tr><td>a</td></tr>stray <b>bold</b><tr><td>b</td></tr></table>": "stray bold\na\nb",
    "<table><tr>text<td>a<td>b</table>": "text\na | b",
    "<table><tr><form><td>x</td><td>y</td></form></tr><tr><td>1<td>2</table>": "x | y\n1 | 2",
    "<table><tr><td>a</td></tr><p>rest of <i>the</i> page<ul><li>one<li>two</ul>": "rest of the page\n\n- one\n- two\na",
    "<table>zero<tbody>first<tr><td>a</td>last</tr>after</tbody><caption>cap</caption>end</table>": "zero\nfirst\nlast\nafter\nend\ncap\na",
    "<table><div>in<tr><td>a</td><td>b</td></tr>out</div></table>": "in\nout\na | b",
    "<table><tr><td>a</td></tr><tr><td>b</td></tr><p>p <table><tr><td>inner<td>n</table>": "p\n\ninner | n\na\nb",
    "<table><tr hidden>no<td>no</td></tr><form hidden>no<tr><td>yes</td></tr></form><script>no</script></table>": "yes",
}


def test_text_of_a_table_outside_its_cells_is_kept():
    for page, expected in LOOSE.items():
        assert html_text.extract(page)[1] == expected, page


SEEN = {
    "<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac><annotation encoding='t'>no</annotation></math> be": "Let x=1y be",
    "<svg width=1><defs><text>no</text></defs><path d='M0'/><title>no</title><g><text x=1>A <tspan>B</tspan></text><text/><text>C</text></g>no<foreignObject><p>D</p></foreignObject></svg>end": "A B C\n\nD\n\nend",
    "<svg><path d=1><p>rest <b>of</b> page": "rest of page",
    "one <svg/> two <svg><circle/><text display=none>no</text></svg> three": "one two three",
    "Pick <select><option disabled>no<option>first<option>no</select> now": "Pick first now",
    "<select><optgroup label=no><option>no<option selected> the  one <optgroup label=no><option>no</select>": "the one",
    "<select multiple><option>a<option hidden>no<option label=b>no</select>": "a b",
    "<select size=3><option>a<option>b</select><datalist><option>no</datalist>": "a b",
    "<table><tr><td><select><option>in</select><td><math><mi>z</mi></math></table>": "in | z",
}


def test_formulas_drawings_and_choices_are_seen():
    for page, expected in SEEN.items():
        assert html_text.extract(page)[1] == expected, page


def test_spans_beyond_fifty():
    rows = "".join(f"<tr><td>r{i}" for i in range(1, 80))
    lines = html_text.extract(f"<table><tr><td rowspan=80>all<td>r0{rows}</table>")[1].split("\n")
    assert lines[0] == "all | r0" and lines[1:] == [f"    | r{i}" for i in range(1, 80)]
    assert html_text.extract("<table><tr><td rowspan=0>all<td>a<tr><td>b</table>")[1] == "all | a\n    | b"
    wide = html_text.extract("<table><tr>" + "<td>x" * 60 + "<td>y<tr><td colspan=60>w<td>z</table>")[1].split("\n")
    assert wide[0].index("y") == wide[1].index("z")


def test_what_is_hidden_stays_hidden_at_any_depth():
    for n in (300, 400, 5000):
        assert html_text.extract("<div>" * n + "<div hidden>SECRET</div>")[1] == ""
        assert html_text.extract("<font>" * n + "<ul><li>a<li hidden>no<li>b</ul><table><tr><td>x<td>y</table>")[1] == "- a\n- b\n\nx | y"


def test_columns_are_aligned_whatever_their_width():
    wide = "w" * 300
    lines = html_text.extract(f"<table><tr><td>{wide}<td>1<tr><td>a<td>2</table>")[1].split("\n")
    assert lines[0].index("| 1") == lines[1].index("| 2") == 301
    huge = html_text.extract("<table><tr><td>" + "x" * 1_000_000 + "<td>b" + "<tr><td>a<td>b" * 10_000 + "</table>")[1]
    assert len(huge) < 1_100_000 and huge.count("a | b") == 10_000


def test_references_of_any_length():
    assert html_text.extract("a&#" + "9" * 6000 + ";b&#" + "0" * 6000 + "65;&#x" + "0" * 6000 + "42;&#xfffffffff;")[1] == "a�bAB�"


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<table><tr><td>" * 5000, "<ul><li>x" * 5000, "<select><option>" * 20_000, "<svg><foreignObject>" * 10_000, "<table>" + "<tr><td rowspan=65534 colspan=1000>" * 2000, "<table>" + "".join(f"<tr><td rowspan={9000 - i}>x" for i in range(4000)), "<b><p>" * 20_000, "<h1><h2>" * 20_000])
def test_hostile_pages_take_no_more_than_their_length(page):
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 20


class Model:
    """A page drawn at random as a model; what it says and how it is written come from the model apart, so neither leans on the parser."""

    def __init__(self, seed):
        self.r = random.Random(seed)
        self.lines, self.gap = [], False
        self.html = "".join(self.block(0) for _ in range(self.r.randint(1, 6)))

    def words(self):
        return " ".join(self.r.choice(["rain", "sun", "é", "x1", "tree"]) for _ in range(self.r.randint(1, 4)))

    def inline(self, text):
        r, first, *rest = self.r, *text.split()
        first = r.choice(["{}", "<b>{}</b>", "<i class='a>b'>{}</i>", "<span>{}<script>no()</script></span>", "{}<!-- no -->", "{}<span hidden> no</span>"]).format(first)
        return r.choice([" ", "\n  ", "\t"]).join([first, *rest])

    def say(self, line):
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def block(self, depth):
        r = self.r
        kind = r.choice(["p", "h2", "div", "list", "table", "hidden"] + ["nest"] * (depth < 3))
        if kind in ("p", "h2", "div"):
            text = self.words()
            self.gap |= kind != "div"
            self.say(text)
            self.gap |= kind != "div"
            return f"<{kind}>{self.inline(text)}" + ("</p>" if kind == "p" and r.random() < 0.5 else "" if kind == "p" else f"</{kind}>")
        if kind == "hidden":
            return r.choice(["<div hidden>no <p>no</div>", "<p style='display:none'>no</p>", "<template><p>no</template>", "<div aria-hidden=true><ul><li>no</ul></div>"])
        if kind == "nest":
            return "<div>" + "".join(self.block(depth + 1) for _ in range(r.randint(1, 3))) + "</div>"
        if kind == "list":
            self.gap = True
            out = self.list(0)
            self.gap = True
            return out
        rows = [[self.words() for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 3))]
        widths = [max((len(row[k]) for row in rows if k < len(row)), default=0) for k in range(3)]
        self.gap = True
        for row in rows:
            self.say(" | ".join([*(t.ljust(w) for t, w in zip(row[:-1], widths, strict=False)), row[-1]]))
        self.gap = True
        end = r.choice(["</td>", ""])
        return "<table>" + "".join("<tr>" + "".join(f"<td>{self.inline(t)}{end}" for t in row) for row in rows) + "</table>"

    def list(self, level):
        r = self.r
        ordered, out = r.random() < 0.5, []
        for k in range(r.randint(1, 3)):
            text = self.words()
            self.say("  " * level + (f"{k + 1}. " if ordered else "- ") + text)
            inner = self.list(level + 1) if level < 2 and r.random() < 0.3 else ""
            out.append(f"<li>{self.inline(text)}{inner}" + r.choice(["</li>", ""]))
        tag = "ol" if ordered else "ul"
        return f"<{tag}>{''.join(out)}</{tag}>"


def test_random_pages_say_what_their_models_say():
    for seed in range(1500):
        model = Model(seed)
        assert html_text.extract(model.html)[1] == "\n".join(model.lines), (seed, model.html)


def test_tables_of_any_size_are_aligned_alike():
    wide, row = "w" * 600, "<tr><td>a<td>b"
    for n in (1, 10, 10_000):  # 6 MB of spaces over 60 KB of text at last
        lines = html_text.extract(f"<table><tr><td>{wide}<td>1{row * n}</table>")[1].split("\n")
        assert lines == [f"{wide} | 1"] + [f"{'a':600} | b"] * n


def test_wide_tables_are_folded_with_their_cells_in_columns():
    for n in (1, 1000):
        lines = html_text.extract("<table><tr><td>" + "x" * 5000 + "<td>b<td>c" + "<tr><td>a<td>bb<td>c" * n + "</table>")[1].split("\n")
        assert lines == ["x" * 5000, "  | b  | c"] + ["a | bb | c"] * n
        lines = html_text.extract("<table><tr>" + "".join(f"<td>{k:04}" for k in range(1000)) + "<tr><td colspan=999><td>last" * n + "</table>")[1].split("\n")
        folded = lines[: -n]
        assert len(folded) == 2 and " | ".join(folded) == " | ".join(f"{k:04}" for k in range(1000)) and max(map(len, folded)) <= 4096
        assert {x.index("last") for x in lines[-n:]} == {folded[1].index("0999")}
