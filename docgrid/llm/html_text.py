"""Operator 6: main text of web pages.

The standard library's HTML parser streams events. Text between block boundaries is a line; each line knows its text
and the tags on it. The ratio of text characters to tags is smoothed over neighbouring lines by a Gaussian and lines at
or over a threshold (the standard deviation of the smoothed ratios) are the content cluster. The lowest element that holds most of the cluster's
text leads to the content region: the article around it (or main, where there is none), or else the widest block around it that adds no
menus and the like, and any block below body that adds lines of the cluster. All lines of the region are returned, short ones too. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments never count: they are known by tag, role, or words in class and id.

Character references are decoded; white space inside a line becomes one blank, lines are trimmed, empty ones go, and
the rest is joined in page order by line breaks. A line break tag is white space. Null or empty html, and pages without content, give
an empty text. End tags that HTML lets out (of p, li, dt, dd, tr, td, th, option, head and so on) are put in; other unclosed elements end with their parent.
Inside an article or main, headings count whatever their class and id, and an id tells furniture only if all its words do. Every page is judged by itself, so repeated pages give equal results.
Extra columns pass through; one that has the name of the added column is replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm.common import CHUNK_BYTES, importable, sliced, table, without_columns

SIGMA = 1.5
REGION_SHARE = 0.7
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line where they begin and end.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Of these, the ones that lines belong to.
CONTAINER = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol section table tbody td tfoot th thead tr ul".split())
#: Of these, the ones that can hold a whole text; others are parts of one.
WHOLE = frozenset("article body center div form html main section".split())
NEVER = frozenset("aside button canvas dialog footer form head header iframe math menu nav noscript object script select style svg template textarea".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promotion related reply respond "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT = frozenset("comment comments commentlist disqus reply respond".split())
#: Words that stand beside HINTS in ids of page furniture.
BESIDE = frozenset("area articles bar block box btn button buttons container content form icon icons inner item items left link links list main media outer panel post posts right section site top bottom wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without end tags: tag: (elements that its start ends, elements that hold these off).
_LIST, _TABLE = frozenset("ul ol menu dl".split()), frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), _LIST),
    "dt": (frozenset(["dt", "dd"]), _LIST),
    "dd": (frozenset(["dt", "dd"]), _LIST),
    "td": (frozenset(["td", "th"]), _TABLE),
    "th": (frozenset(["td", "th"]), _TABLE),
    "tr": (frozenset(["td", "th", "tr", "caption"]), _TABLE),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("td th tr tbody thead tfoot caption".split()), _TABLE)),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: These end an open p.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul "
    "li dt dd td th tr tbody thead tfoot".split()
)
OPTIONAL = frozenset("p li dt dd option optgroup".split())
IN_HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def is_noise(tag: str, attrs: list, in_article: bool = False) -> bool:
    if tag in NEVER:
        return True
    for name, value in attrs:
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value or "")}
            if words & (COMMENT if tag in ("article", "main") else HINTS) and tag not in ("html", "body"):
                if not in_article or tag not in HEADINGS and (name == "class" or words <= HINTS | BESIDE):
                    return True
        elif name == "role":
            if (value or "").lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value or ""):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page: text, number of tags, element (a number; `parent` tells where it lies), and whether it can count."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.name, self.stack = [-1], [""], [("", 0, False)]
        self.noise = self.articles = 0
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, bool]] = []

    def end_line(self):
        body = " ".join("".join(self.text).split())
        if body:
            self.lines.append((body, self.tags, self.stack[-1][1], not self.noise))
            self.tags = 0
        self.text.clear()

    def pop(self, i: int):
        """End the elements from the i-th of the stack on."""
        if any(x[2] for x in self.stack[i:]):
            self.end_line()
        for tag, _, noise in self.stack[i:]:
            self.noise -= noise
            self.articles -= tag in ("article", "main")
        del self.stack[i:]

    def end_implied(self, tag: str):
        """End what the start of `tag` ends."""
        if self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.pop(len(self.stack) - 1)
        if tag in ENDS_P:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == "p":
                    self.end_line()
                    self.pop(i)
                    break
                if self.stack[i][0] in CONTAINER or self.stack[i][0] in ("button", "object", "template", *OPTIONAL):
                    break
        if tag in ENDS:
            ended, off = ENDS[tag]
            last = 0
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.stack[i][0]
                if name in ended:
                    last = i
                elif name in off or name not in ended and name in CONTAINER and name not in ("tr", "tbody", "thead", "tfoot"):
                    break
            if last:
                self.end_line()
                self.pop(last)

    def handle_starttag(self, tag, attrs):
        self.end_implied(tag)
        block = tag in BLOCK
        noise = is_noise(tag, attrs, self.articles > 0)
        if block or noise:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            self.text.append(" ")
            return
        if tag in ("td", "th"):
            self.text.append(" ")
        if noise or tag in CONTAINER or tag in OPTIONAL:
            inside = self.stack[-1][1]
            if tag in CONTAINER:
                self.parent.append(inside)
                self.name.append(tag)
                inside = len(self.parent) - 1
            self.stack.append((tag, inside, noise))
            self.noise += noise
            self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in ("td", "th"):
            self.text.append(" ")
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                break
            if tag in OPTIONAL and self.stack[i][0] in CONTAINER:
                break

    def handle_data(self, data):
        self.text.append(data)

    def done(self) -> list:
        self.close()
        self.end_line()
        return self.lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of neighbours; weights that fall outside go to those inside."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def widen(best: int, parent: list[int], name: list[str], weight: np.ndarray, noise: np.ndarray) -> int:
    """The content element around `best`; weight and noise: the cluster's text and the lines that never count, by element with all below it."""
    around = [best]
    while around[-1]:
        around.append(parent[around[-1]])
    for tag in ("article", "main"):
        for i in around:
            if name[i] == tag:
                return i
    for i in around[1:]:
        if name[best] in WHOLE and noise[i] > noise[best] and (name[i] in ("", "html", "body") or weight[i] <= weight[best]):
            break
        best = i
    return best


def region(lines: list, parent: list[int], name: list[str], sigma: float = SIGMA, share: float = REGION_SHARE) -> list[str]:
    """The lines of the content region."""
    able = np.array([x[3] for x in lines], bool)
    if not able.any():
        return []
    size = np.array([len(x[0]) for x in lines], np.float64)
    ratio = smooth(np.where(able, size, 0.0) / np.maximum([x[1] for x in lines], 1), sigma)
    cluster = able & (ratio >= ratio.std())
    if not cluster.any():
        cluster = able
    weight = np.zeros(len(parent))
    np.add.at(weight, [x[2] for x in lines], np.where(cluster, size, 0.0))
    for i in range(len(parent) - 1, 0, -1):  # children come after their parents
        weight[parent[i]] += weight[i]
    noise = np.bincount([x[2] for x in lines], ~able, minlength=len(parent))
    for i in range(len(parent) - 1, 0, -1):
        noise[parent[i]] += noise[i]
    best = widen(max(i for i in range(len(parent)) if weight[i] >= share * weight[0]), parent, name, weight, noise)
    inside = np.zeros(len(parent), bool)
    inside[best] = True
    for i in range(best + 1, len(parent)):
        inside[i] = inside[parent[i]]
    return [x[0] for x in lines if x[3] and inside[x[2]]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    return "\n".join(region(p.done(), p.parent, p.name))


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every page."""
    importable(df.sparkSession)
    df = without_columns(df, text)

    def run(batches):
        for part in sliced(batches, html, CHUNK_BYTES):
            made = pa.array(map(main_text, part.column(part.schema.get_field_index(html)).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
