"""Text predicates and clean-up as column expressions (families A and B)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def documents_as_sources(docs: DataFrame) -> DataFrame:
    """``sources(topic_id, src_idx, doc_id, content)``: topic = lang, source = its name, a null one empty."""
    return docs.select(F.col("lang").alias("topic_id"), F.coalesce("source", F.lit("")).alias("src_idx"), "doc_id", F.col("text").alias("content"))


def filter_urls(df: DataFrame, skip: list[str], extensions: tuple = ("pdf", "doc", "docx", "xls", "xlsx"), url: str = "url") -> DataFrame:
    """Drop urls that hold a skip substring or end in a document extension, in any case."""
    low = F.lower(F.col(url))
    bad = low.rlike(r"\.(" + "|".join(extensions) + ")$")
    for s in skip:
        bad = bad | low.contains(s.lower())
    return df.filter(~bad)


def admit_sources(df: DataFrame, min_chars: int = 500, cap: int = 200_000, most_headings: int = 15) -> DataFrame:
    """Sources of at least ``min_chars`` and at most ``most_headings`` markdown headings, in order, while the size before them is under ``cap``.

    No more than ``cap / min_chars`` of them can be admitted, so the rank limit loses nothing, and every
    partition drops the rest of a topic before the shuffle.
    """
    order = Window.partitionBy("topic_id").orderBy("src_idx", "doc_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sized = df.withColumn("chars", F.length("content")).filter((F.col("chars") >= min_chars) & (F.regexp_count("content", F.lit(r"(?m)^#{1,6}\s")) <= most_headings))
    if min_chars > 0:
        sized = sized.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap // min_chars + 1).drop("rank")
    sized = sized.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    return sized.filter(F.col("before") < cap).withColumn("word_count", F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")))


def domain_of(url: Column) -> Column:
    """The host without ``www.``, else the first 30 characters."""
    host = F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#]+)", 1)
    return F.when(host != "", host).otherwise(F.substring(url, 1, 30))


def strip_markup(text: Column) -> Column:
    """Plain text from markdown."""
    x = F.regexp_replace(text, r"(?m)^#{1,6}\s*", "")
    x = F.regexp_replace(x, r"\*\*(.+?)\*\*", "$1")
    x = F.regexp_replace(x, r"\*(.+?)\*", "$1")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1")
    x = F.regexp_replace(x, r"(?m)^-{3,}$", "")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def html_headings(pages: DataFrame, level: int = 2, keys: tuple = ("page_id",)) -> DataFrame:
    """``(keys, pos, heading)``: inner tags removed, trimmed, under 200 characters."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1))
    rows = pages.select(*keys, F.posexplode(found).alias("pos", "raw"))
    rows = rows.withColumn("heading", F.trim(F.regexp_replace("raw", "<[^>]+>", ""))).drop("raw")
    return rows.filter((F.length("heading") > 0) & (F.length("heading") < 200) & ~F.col("heading").rlike(r"[{}]|webkit|@media"))


#: Roles and class names of page chrome, and phrases of cookie banners.
ROLES = ("navigation", "banner", "contentinfo", "complementary")
CHROME = ("sidebar", "breadcrumb", "cookie", "newsletter", "social", "related", "comments", "advert", "widget", "menu", "pagination")
COOKIES = (r"(?i)we use cookies[^.\n]*\.?", r"(?i)accept (?:all )?cookies", r"(?i)cookie (?:policy|settings|preferences)")


#: Elements that are chrome as such, and elements after which a line ends.
CHROME_TAGS = ("nav", "footer", "header", "aside", "noscript", "iframe")
LINE_TAGS = ("p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "section", "article", "blockquote", "pre")
#: Comments, and elements whose content is no markup and cannot nest.
RAW = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
TAG = re.compile(r"(<[^>]+>)")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
BLANKS = re.compile(r"[ \t\n\f\r]+")


def marks_of_chrome(chrome: tuple = CHROME) -> str:
    """A pattern for the attributes of chrome blocks: their role, or a word in their class or id."""
    return rf"(?i)role\s*=\s*[\"']?(?:{'|'.join(ROLES)})|(?:class|id)\s*=\s*[\"'][^\"'>]*(?:{'|'.join(chrome)})"


def visible_text(html: str, marks: re.Pattern, lines: bool) -> str:
    """Text outside of chrome blocks; each block reaches to the closing tag of its own opening tag, whatever is nested in it.

    One pass over the tags keeps a stack of open elements by name; a block that is never closed is no block. With ``lines`` the tags of
    ``LINE_TAGS`` end lines, else all space is collapsed.
    """
    parts = TAG.split(html)
    ends, begun, blocks = [" "] * len(parts), {}, []
    for k in range(1, len(parts), 2):
        found = NAME.match(parts[k])
        if not found:
            continue
        closing, name = found[1], found[2].lower()
        if lines and name in LINE_TAGS:
            ends[k] = "\n"
        if closing:
            if begun.get(name):
                start, is_chrome = begun[name].pop()
                if is_chrome:
                    blocks.append((start, k))
        elif not parts[k].endswith("/>"):
            begun.setdefault(name, []).append((k, name in CHROME_TAGS or bool(marks.search(parts[k]))))
    out, at = [], 0
    for start, end in sorted(blocks):
        if start >= at:
            out += (parts[k] if k % 2 == 0 else ends[k] for k in range(at, start + 1))
            at = end
    out += (parts[k] if k % 2 == 0 else ends[k] for k in range(at, len(parts)))
    if not lines:
        return BLANKS.sub(" ", "".join(out)).strip(" ")
    return "\n".join(filter(None, (BLANKS.sub(" ", x).strip(" ") for x in "".join(out).split("\n"))))


def html_main_text(html: Column, cap: int | None = None, chrome: tuple = CHROME, lines: bool = False) -> Column:
    """Visible text: scripts, styles, comments, chrome blocks by tag, role and class with all that is nested in them, and tags removed.

    Space is collapsed; with ``lines`` block elements end lines, which are trimmed and not empty.
    """
    pattern = re.compile(marks_of_chrome(chrome))

    def shown(page: str | None) -> str | None:
        return None if page is None else visible_text(page, pattern, lines)

    visible = F.udf(shown, "string", useArrow=False)  # rows travel by the hundred, so that a task holds few pages, however large
    return visible(F.regexp_replace(html if cap is None else F.substring(html, 1, cap), RAW, " "))


def strip_artifacts(text: Column) -> Column:
    """Entities to spaces; footnote marks, templates, urls, long upper-case or digit runs and cookie banners out."""
    x = F.regexp_replace(text, r"&[a-zA-Z]+;|&#\d+;", " ")
    for p in (r"\[\d+\]", r"\{\{[^}]*\}\}", r"https?://\S+", r"\b[A-Z0-9]{20,}\b", *COOKIES):
        x = F.regexp_replace(x, p, "")
    return x


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, line)`` of trimmed lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))


def line_flags(line: Column, stop: list[str]) -> dict[str, Column]:
    """Counts, stop-word density, capitalised share, final mark and the boilerplate flag of a trimmed line."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    chars, n_words = F.length(line), F.size(words)
    many = F.greatest(n_words, F.lit(1))
    listed = F.array(*[F.lit(s) for s in stop])
    density = F.size(F.filter(words, lambda w: F.array_contains(listed, F.lower(w)))) / many
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / many
    final = line.rlike(r"[.!?]$")
    return {"chars": chars, "n_words": n_words, "density": density, "capital": capital, "final": final, "boilerplate": boilerplate(chars, n_words, density, capital, final)}


def boilerplate(chars: Column, n_words: Column, density: Column, capital: Column, final: Column) -> Column:
    """True of very short lines, and of short ones without stop words and final mark, or of capitalised words."""
    return (chars < 5) | ((chars < 60) & (density < 0.15) & ~final) | ((chars < 60) & (capital > 0.6) & (n_words <= 5)) | ((n_words <= 3) & (density == 0) & ~final)


def line_features(lines: DataFrame, stop: list[str]) -> DataFrame:
    """The rows with the columns of ``line_flags``; what several of them use is computed once a line."""
    counted = {k: v for k, v in line_flags(F.col("line"), stop).items() if k != "boilerplate"}
    return lines.withColumns(counted).withColumn("boilerplate", boilerplate(*(F.col(c) for c in ("chars", "n_words", "density", "capital", "final"))))


def finish_text(text: Column, cap: int | None = None) -> Column:
    x = F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " "))
    return x if cap is None else F.substring(x, 1, cap)


def clean_lines(docs: DataFrame, nav: str, stop: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Without navigation lines and the lines after them until text resumes: a line of over 50 characters after the third, or the ninth.

    A line looks back eight lines at most for the navigation line whose skip it may stand in, in its document's own row:
    nothing is shuffled, and a document costs what its lines do. With a list ``stop`` of stop words the lines that are left are judged: those of the
    shape of navigation (``nav_shape``, ``boilerplate``) and single words without a digit go too.
    """
    rows = docs.select(key, F.transform(F.split(text, "\n"), lambda x: F.trim(x)).alias("lines"))
    rows = rows.withColumns({"hit": F.transform("lines", lambda x: x.rlike(nav) & (F.length(x) < 150)), "long": F.transform("lines", lambda x: F.length(x) > 50)})
    at = lambda flags, i, back: F.coalesce(F.when(i >= back, F.get(flags, i - back)), F.lit(False))

    def skipped(i: Column, back: int) -> Column:
        """The skip begun ``back`` lines before lasts to this line."""
        going = at("hit", i, back)
        for k in range(back):
            going = going & ~at("hit", i, k)
            if back - k > 3:
                going = going & ~at("long", i, k)
        return going

    kept = F.filter("lines", lambda x, i: ~reduce(lambda a, b: a | b, [skipped(i, back) for back in range(9)]))
    if stop is not None:
        kept = F.filter(kept, lambda x: ~_judged(x, stop))
    return rows.select(key, F.array_join(kept, "\n").alias("text"))


def _judged(line: Column, stop: list[str]) -> Column:
    flags = line_flags(line, stop)
    return nav_shape(line, flags["n_words"], flags["capital"]) | ((flags["n_words"] < 2) & ~line.rlike(r"\d")) | flags["boilerplate"]


def nav_shape(line: Column, n_words: Column, capital: Column) -> Column:
    """One of the shapes of navigation lines."""
    n = F.length(line)
    shape = (n < 3) | ((n < 30) & line.rlike("[→►»›]$")) | line.rlike(r"^[-=_*|•·]+$") | line.rlike(r"^\d+$") | line.rlike(r"^\p{L}{1,4}$") | line.rlike(r"^\p{L}{3,12}\.? (?:19|20)\d\d$")
    return shape | (n_words.between(1, 2) & (capital == 1))


def flag_nav_lines(features: DataFrame) -> DataFrame:
    """Add ``nav`` to the rows of ``line_features``: boilerplate, or one of the shapes of navigation lines."""
    return features.withColumn("nav", F.col("boilerplate") | nav_shape(F.col("line"), F.col("n_words"), F.col("capital")))


def strip_css(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))
