"""Text functions as Column to Column: built-in expressions, no Python on the executors.

"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escaped control sequences that extractors leave in text, and control characters but tab, LF and CR.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ESCAPED_CONTROLS = r"\\x0[0-8bBcCeEfF]|\\x1[0-9a-fA-F]|\\x7[fF]|\\u000[0-8bBcCeEfF]|\\u001[0-9a-fA-F]"
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))
#: Key prefixes in the order in which they decide, with the label of each.
PROVIDERS = (("gsk_", "groq"), ("AIza", "gemini"), ("nvapi-", "nvidia"), ("sk-ant-", "anthropic"), ("co-", "cohere"), ("sk-or-", "openrouter"), ("sk-", "openai"))
#: Extensions and the library's type for them.
FILE_TYPES = (("pdf", ("pdf",)), ("docx", ("doc", "docx")), ("txt", ("txt",)), ("csv", ("csv", "tsv")), ("json", ("json",)), ("md", ("md",)), ("image", ("png", "jpg", "jpeg", "svg", "webp")))
#: What PDF text shows for characters beyond ASCII; all others are blanks.
PDF_FOLDS = (("\u2019", "'"), ("\u2018", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2014", " - "), ("\u2013", "-"), ("\u2022", "*"), ("\u2026", "..."), ("\u00b0", " deg "), ("\u00b5", "u"), ("\u00b1", "+/-"))
#: Words in a platform's name, in the order in which they decide.
PLATFORMS = (("mac|darwin|apple|os x", "macos"), ("win", "windows"), ("android", "android"), ("ipad|iphone|ios", "ios"), ("linux", "linux"))


#: The only keys of JSON objects that streams send for a piece of text, but for one nested form.
FRAGMENT_KEYS = ("token", "text", "content", "response", "reply")
#: What is read aloud in place of code.
CODE_PHRASE = "Code block omitted."


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def trim(text: Column) -> Column:
    """White space of any kind off both ends."""
    return replaced(text, (r"(?U)^\s+", ""), (r"(?U)\s+$", ""))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def one_line(text: Column) -> Column:
    """Words with single blanks between them."""
    return F.array_join(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), " ")


def _by_lines(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def without_code(text: Column) -> Column:
    """Fenced code as a phrase; a fence that is never closed stays."""
    parts = F.split(text, "```")

    def spoken(part: Column, i: Column) -> Column:
        inside = i % 2 == 1
        return F.when(inside & (i == F.size(parts) - 1), F.concat(F.lit("```"), part)).when(inside, CODE_PHRASE).otherwise(part)

    return F.when(text.contains("```"), F.array_join(F.transform(parts, spoken), "")).otherwise(text)


def speech(text: Column) -> Column:
    """T5: what is read aloud: no code blocks, markers or marks of formatting; inline code without its marks."""
    plain = F.regexp_replace(without_code(text), "`([^`]+)`", "$1")
    unmarked = F.regexp_replace(plain, r"\[\^?\d+\]", "")
    return one_line(F.translate(unmarked, "#*_~>", ""))


# What names a file in brackets, and the marks that have no blank before them.
CITED_SUFFIXES = (".pdf", ".doc", ".txt", ".md", ".xls")
CLOSING_MARKS = (".", ",", ";", ":", "!", "?")
_NUMBERS = r"^[0-9]([0-9,\s]*[0-9])?$"


def _is_marker(inside: Column) -> Column:
    """Whether what stands in square brackets is numbers with commas between them, without blanks at the ends."""
    return F.coalesce(inside.rlike(_NUMBERS) & F.forall(F.split(inside, ","), lambda n: trim(n).rlike("^[0-9]+$")), F.lit(False))


def _brackets(text: Column, opening: str, closing: str) -> Column:
    """The text cut before each opening bracket: structs of what is inside (null for the first and for one that is not closed) and of what follows."""

    def piece(p: Column, i: Column) -> Column:
        end = F.instr(p, closing)
        closed = (i > 0) & (end > 0)
        return F.struct(F.when(closed, F.substr(p, F.lit(1), end - 1)).alias("inside"), F.when(closed, F.substr(p, end + 1)).when(i > 0, F.concat(F.lit(opening), p)).otherwise(p).alias("rest"))

    return F.transform(F.split(text, "\\" + opening, -1), piece)


def _rewritten(text: Column, opening: str, closing: str, read, kept) -> Column:
    """The text with each piece of ``_brackets``, as ``read`` makes it, replaced by what ``kept`` says of it, of its place and of all pieces."""

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: kept(p, i, pieces)), "")

    return let(text, lambda t: F.when(t.contains(opening), let(F.transform(_brackets(t, opening, closing), read), joined)).otherwise(t))


def _without_markers(text: Column) -> Column:
    """No markers, nor white space before them."""

    def read(p: Column) -> Column:
        is_marker = _is_marker(p["inside"])
        return F.struct(is_marker.alias("is"), F.when(is_marker | p["inside"].isNull(), p["rest"]).otherwise(F.concat(F.lit("["), p["inside"], F.lit("]"), p["rest"])).alias("own"))

    def kept(p: Column, i: Column, pieces: Column) -> Column:
        return F.when(F.coalesce(F.get(pieces, i + 1)["is"], F.lit(False)), replaced(p["own"], (r"(?U)\s+$", ""))).otherwise(p["own"])

    return _rewritten(text, "[", "]", read, kept)


def _without_references(text: Column) -> Column:
    """No round brackets that name a file and a page, nor those that name one of both and have a marker behind them, with that marker."""
    is_page = lambda part: F.lower(part).rlike(r"^(page|p\.?)\s*[0-9]")
    is_file = lambda part: F.exists(F.array(*map(F.lit, CITED_SUFFIXES)), lambda s: F.contains(F.lower(part), s))
    marker = r"\[[0-9][0-9,\s]*\]"

    def read(p: Column) -> Column:
        parts = F.split(F.when(~p["inside"].contains("\n"), p["inside"]), ",")
        places = lambda test: F.filter(F.transform(parts, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())

        def judged(at: Column) -> Column:
            pages, files, first = at["pages"], at["files"], F.array_min(at["pages"]) == 0
            # a page behind the file, or at the beginning with the file behind it
            both = (F.array_min(files) < F.array_max(pages)) | (first & (F.array_max(files) > 0))
            cited = p["rest"].rlike("^\\s*" + marker)
            return F.when(both, F.when(cited, "both cited").otherwise("both")).when(((F.size(files) > 0) | first) & cited, "one")

        names = F.struct(places(lambda x, i: is_page(F.when(i == 0, x).otherwise(F.ltrim(x)))).alias("pages"), places(lambda x, i: is_file(x)).alias("files"))
        return F.struct(let(names, judged).alias("kind"), p["inside"].alias("inside"), p["rest"].alias("rest"))

    def kept(p: Column, i: Column, pieces: Column) -> Column:
        marked = F.coalesce(F.get(pieces, i - 1)["rest"].rlike(marker + "\\s*$"), F.lit(False))
        bare = F.regexp_replace(p["rest"], "^\\s*" + marker, "")
        return (
            F.when(p["kind"].startswith("both") & marked, p["rest"]).when(p["kind"].isin("both cited", "one"), bare).when(p["kind"] == "both", replaced(p["rest"], (r"^\s+", "")))
            .when(p["inside"].isNull(), p["rest"]).otherwise(F.concat(F.lit("("), p["inside"], F.lit(")"), p["rest"]))
        )

    return _rewritten(text, "(", ")", read, kept)


def _closed_up(text: Column) -> Column:
    """No white space before closing marks."""

    def at(so_far: Column, mark: str) -> Column:
        def joined(cut: Column) -> Column:
            return F.array_join(F.transform(cut, lambda p, i: F.when(i < F.size(cut) - 1, replaced(p, (r"\s+$", ""))).otherwise(p)), mark)

        return let(so_far, lambda t: F.when(t.contains(mark), let(F.split(t, f"[{mark}]", -1), joined)).otherwise(t))

    return reduce(at, CLOSING_MARKS, text)


def copied(text: Column, verbose: bool = True) -> Column:
    """T4: text for the clipboard: no citations or markers with the blanks before them, no blanks before closing marks, single blanks, no blanks at ends of lines.

    ``verbose``: round brackets that name a file and a page go as well, and those that name one of both with a marker behind them.
    """
    read = _closed_up(_without_markers(_without_references(text) if verbose else text))
    return trim(_by_lines(read, lambda line: F.rtrim(F.regexp_replace(line, r"[ \t]{2,}", " "), F.lit(" \t\r\f\x0b"))))


def unwrapped(text: Column) -> Column:
    """JSON fragments of a stream as the text in them, as it stands where it is not valid JSON."""
    string = r'"(?:[^"\\]|\\.)*"'
    delta = rf'\{{"delta":\s*\{{"content":\s*{string}\}}\}}'
    single = rf'\{{"(?:{"|".join(FRAGMENT_KEYS)})":\s*{string}\}}'
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{delta}|{single}"), F.lit(0)))
    paths = ("$.delta.content", *(f"$.{k}" for k in FRAGMENT_KEYS))

    def inner(fragment: Column) -> Column:
        raw = F.regexp_extract(fragment, rf":\s*({string})\}}+$", 1)
        return F.coalesce(*(F.get_json_object(fragment, p) for p in paths), F.substr(raw, F.lit(2), F.length(raw) - 2))

    return F.when(text.contains('{"'), F.aggregate(found, text, lambda so_far, x: F.replace(so_far, x, inner(x)))).otherwise(text)


def sanitized(text: Column) -> Column:
    """JSON fragments unwrapped, remains of the protocol and control characters gone, bullets in paragraphs of their own, no runs of blank lines."""

    def kept(line: Column) -> Column:
        bare = F.when(line.startswith("data:"), F.ltrim(F.substr(line, F.lit(6)))).otherwise(line)
        return F.when(line.rlike(r"^:\s*keepalive\s*$"), "").otherwise(bare)

    plain = F.replace(_by_lines(unwrapped(text), kept), F.lit("[DONE]"), F.lit(""))
    plain = F.regexp_replace(plain, f"{CONTROLS}|{ESCAPED_CONTROLS}", "")
    spaced = F.regexp_replace(plain, r"(?<=[^\n])\s*•\s*", "\n\n• ")
    return F.regexp_replace(spaced, r"\n{3,}", "\n\n")


def deduplicated_markers(text: Column) -> Column:
    """No index twice in a bracket, no bracket twice in a row, no blank before the mark that precedes a bracket."""

    def read(p: Column) -> Column:
        numbers = F.array_distinct(F.transform(F.split(p["inside"], ","), lambda n: trim(n).cast("decimal(38,0)").cast("string")))
        inside = F.when(_is_marker(p["inside"]), F.when(p["inside"].contains(","), F.array_join(numbers, ", ")).otherwise(p["inside"]))
        return F.struct(inside.alias("mark"), p["inside"].alias("inside"), p["rest"].alias("rest"), F.translate(p["rest"], " \t", "").alias("bare"))

    def kept(p: Column, i: Column, pieces: Column) -> Column:
        def again(here: Column, before: Column) -> Column:
            """Whether a bracket is the one before it again, with nothing but blanks and a comma between them, or a semicolon at once."""
            return F.coalesce((here["mark"] == before["mark"]) & (before["bare"].isin("", ",") | ((before["bare"] == ";") & before["rest"].startswith(";"))), F.lit(False))

        own = F.when(p["inside"].isNull() | again(p, F.get(pieces, i - 1)), F.lit("")).otherwise(F.concat(F.lit("["), F.coalesce(p["mark"], p["inside"]), F.lit("]")))
        return F.concat(own, F.when(again(F.get(pieces, i + 1), p), F.lit("")).otherwise(p["rest"]))

    def close(p: Column, bare: Column) -> Column:
        """What precedes a bracket, with the mark at its end close to the word before it."""
        mark = F.right(bare, F.lit(1))
        word = replaced(F.left(bare, F.length(bare) - 1), (r"(?U)\s+$", ""))
        return F.when(mark.isin(*CLOSING_MARKS), F.concat(word, mark, F.substr(p, F.length(bare) + 1))).otherwise(p)

    def joined(cut: Column) -> Column:
        return F.array_join(F.transform(cut, lambda p, i: F.when(i < F.size(cut) - 1, let(replaced(p, (r"(?U)\s+$", "")), lambda bare: close(p, bare))).otherwise(p)), "[")

    once = _rewritten(text, "[", "]", read, kept)
    return let(once, lambda t: F.when(t.contains("["), let(F.split(t, r"\[", -1), joined)).otherwise(t))


def doc_name(name: Column) -> Column:
    """A file name without its last extension, marks as blanks."""
    dots = F.split(name, r"\.")
    has = (F.size(dots) > 1) & (F.length(F.element_at(dots, -1)) > 0) & ~F.element_at(dots, -1).contains("/")
    stem = F.when(has, F.array_join(F.slice(dots, F.lit(1), F.size(dots) - 1), ".")).otherwise(name)
    return trim(F.translate(stem, "_-", "  "))


def suggestion(text: Column) -> Column:
    """One line without the marks at its end."""
    return trim(F.rtrim(one_line(text), F.lit(".?")))


def title(text: Column, most: int = 42) -> Column:
    """A session's title."""
    one = replaced(trim(F.coalesce(text, F.lit(""))), (r"(?U)\s+", " "))
    return F.when(one == "", "New Chat").when(F.length(one) <= most, one).otherwise(F.concat(trim(F.substring(one, 1, most)), F.lit("...")))


def slug(text: Column, most: int = 36, default: str = "research-response") -> Column:
    """A part of a file name."""
    cut = F.substring(replaced(trim(replaced(F.lower(text), (r"[^a-z0-9\s-]", ""))), (r"\s+", "-")), 1, most)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def export_name(prefix: str, text: Column, day: Column, extension: str) -> Column:
    """Prefix-slug-date.extension."""
    return F.concat(F.lit(f"{prefix}-"), slug(text, 32), F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit(f".{extension}"))


def html_escaped(text: Column) -> Column:
    """T10."""
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), HTML_ENTITIES, text)


def inline_html(text: Column) -> Column:
    """Bold and code of escaped text as HTML."""
    return replaced(html_escaped(text), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"`(.+?)`", "<code>$1</code>"))


def pdf_escaped(text: Column) -> Column:
    """Text for a PDF string: printable ASCII, with backslash and brackets escaped."""
    escaped = F.regexp_replace(text, r"([\\()])", r"\\$1")
    return F.regexp_replace(reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), PDF_FOLDS, escaped), r"[^\x20-\x7E]", " ")


def wrapped(text: Column, columns: int) -> Column:
    """Lines of whole words of up to ``columns`` characters; a longer word has a line of its own; no words: one empty line."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        longer = F.concat(last, F.lit(" "), word)
        fits = (F.length(longer) <= columns) & (last != "")
        return F.when(last == "", F.array(word)).when(fits, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(longer))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array(F.lit("")), step)


def provider(key: Column) -> Column:
    """Whose key it looks like."""
    k = trim(key)
    out = F.when(k == "", "unknown")
    for prefix, label in PROVIDERS:
        out = out.when(k.startswith(prefix) | (F.length(k) == 40 if label == "cohere" else F.lit(False)), label)
    return out.when(k.rlike("^[a-zA-Z0-9]{32}$"), "mistral").otherwise("custom")


def file_type(name: Column) -> Column:
    """T20."""
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    out = F.when(F.lit(False), "")
    for label, extensions in FILE_TYPES:
        out = out.when(extension.isin(*extensions), label)
    return out.otherwise("other")


def platform(name: Column) -> Column:
    """Darwin comes before win, as it has win in it; what is not known counts as macos."""
    n, out = F.lower(F.coalesce(name, F.lit(""))), F.when(F.lit(False), "")
    for words, label in PLATFORMS:
        out = out.when(n.rlike(words), label)
    return out.otherwise("macos")


def system(agent: Column, platform_name: Column) -> Column:
    """The operating system of a browser."""
    a, p = F.lower(F.coalesce(agent, F.lit(""))), F.lower(F.coalesce(platform_name, F.lit("")))
    return (
        F.when(a.contains("android"), "Android").when(a.rlike("iphone|ipad|ipod"), "iOS")
        .when(p.contains("win") | a.contains("windows"), "Windows").when(p.contains("mac") | a.contains("macintosh"), "Mac")
        .when(p.contains("linux") | a.contains("linux"), "Linux").otherwise("Desktop")
    )


def percent_encoded(text: Column) -> Column:
    """A path or query part of a URL."""
    kept = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), kept, F.url_encode(text))


def deep_link(base: Column, name: Column, page: Column) -> Column:
    """A document's address, with its page."""
    return F.concat(base, F.lit("/"), percent_encoded(name), F.when(page > 0, F.concat(F.lit("#page="), page.cast("string"))).otherwise(""))


def origin(url: Column) -> Column:
    """Scheme, host and port of a URL as a browser writes them; null if it is none."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    usual = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    return F.when(F.length(host) > 0, F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port))))


def gateway(url: Column) -> Column:
    """The root of a gateway's address."""
    t = trim(url)
    full = F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(t == "", "").otherwise(F.coalesce(origin(full), F.regexp_replace(full, "/+$", "")))


def checked_url(url: Column) -> Column:
    """struct<is_valid, error, warning, fix, trailing_slash, has_path>; error and warning are codes."""
    t = trim(url)
    low = F.lower(t)
    local = t.rlike(r"^https?://(localhost|127\.0\.0\.1)")
    host, path = F.lower(F.try_parse_url(t, F.lit("HOST"))), F.try_parse_url(t, F.lit("PATH"))
    slash = t.endswith("/")
    has_path = F.coalesce(path, F.lit("")).isin("", "/") == F.lit(False)
    start = F.when(t == "", "empty").when(low.isin("https://", "https:", "https"), "incomplete").when(~local & ~low.startswith("https://"), "scheme")
    error = start.when(host.isNull(), "format").when((F.length(host) < 3) | (~local & ~host.contains(".")), "domain")
    valid = error.isNull()
    fix = F.when(error == "scheme", F.when(low.startswith("http://"), F.concat(F.lit("https://"), F.substr(t, F.lit(8)))).when(~t.contains("://"), F.concat(F.lit("https://"), t))).when(valid & (slash | has_path), origin(t))
    warning = F.when(valid & slash & has_path, "path and slash").when(valid & has_path, "path").when(valid & slash, "slash")
    judged = ~F.coalesce(error, F.lit("")).isin("empty", "incomplete")
    return F.struct(valid.alias("is_valid"), error.alias("error"), warning.alias("warning"), fix.alias("fix"), (judged & slash).alias("trailing_slash"), (valid & has_path).alias("has_path"))


def stripped_html(html: Column) -> Column:
    """A page's text: no scripts, styles, comments or tags; blanks collapsed."""
    plain = replaced(html, (r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "))
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return trim(replaced(plain, (r"\s+", " ")))
