"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9가-힣]+"
_SPACE = r"(?U)\s+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lower_trim(c: Column | str) -> Column:
    return F.lower(strip(text(c)))


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def tokens(c: Column | str) -> Column:
    """Lower-case runs of Latin letters, digits and Hangul syllables; any other character ends a token."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))


def terms(c: Column | str) -> Column:
    """Distinct tokens in the order of their first place."""
    return F.array_distinct(tokens(c))


def lookup_text(c: Column | str) -> Column:
    return F.array_join(terms(c), " ")


def term_hits(haystack: Column, query_terms: Column) -> Column:
    """How many of the terms occur in the text as substrings."""
    low = F.lower(text(haystack))
    return F.size(F.filter(query_terms, lambda t: F.contains(low, t)))


def contains_all(haystack: Column, query_terms: Column) -> Column:
    low = F.lower(text(haystack))
    return (F.size(query_terms) > 0) & (F.length(low) > 0) & F.forall(query_terms, lambda t: F.contains(low, t))


def prefix_run(haystack: Column, query_terms: Column) -> Column:
    """Longest run of the text's terms that start with successive query terms from the first on, as a share of the query."""
    return prefix_run_of(terms(haystack), query_terms)


def prefix_run_of(own: Column, query_terms: Column) -> Column:
    """prefix_run of a text whose terms are given."""
    size = F.size(own)

    def run(start: Column) -> Column:
        state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("going"))

        def step(acc: Column, x: Column) -> Column:
            at = start + x["i"]
            fits = acc["going"] & (at < size) & F.coalesce(F.startswith(F.get(own, at), x["t"]), F.lit(False))
            return F.struct((acc["n"] + fits.cast("int")).alias("n"), fits.alias("going"))

        numbered = F.transform(query_terms, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        return F.aggregate(numbered, state, step, lambda acc: acc["n"])

    runs = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), run)
    return F.when((size == 0) | (F.size(query_terms) == 0), F.lit(0.0)).otherwise(F.array_max(runs) / F.size(query_terms))


def shorten(c: Column, width: int, mark: str = "...") -> Column:
    """Squeezed text, cut before the last word that does not fit together with the mark."""

    def cut(flat: Column) -> Column:
        kept = F.regexp_extract(F.substring(flat, 1, width - len(mark) + 1), r"^(.*)\s", 1)
        return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(kept), F.lit(mark)))

    return let(squeeze(c), cut)


def snippet(content: Column, query: Column, width: int = 300, reach: int = 160) -> Column:
    """Text around the query, or around its first word of over three letters that occurs; empty where nothing does."""

    def found(low: Column, size: Column) -> Column:
        return F.struct(low.alias("at"), size.alias("size"))

    def place(x: Column) -> Column:
        low, q = x["low"], x["q"]
        whole = F.when(F.length(q) > 0, F.instr(low, q)).otherwise(0)
        long = F.filter(F.split(q, r"\s+"), lambda w: (F.length(w) > 3) & F.contains(low, w))
        word = let(F.get(long, F.lit(0)), lambda w: F.when(w.isNotNull(), found(F.instr(low, w), F.length(w))))
        return F.when(whole > 0, found(whole, F.length(q))).otherwise(word)

    def around(p: Column) -> Column:
        start = F.greatest(p["at"] - reach, F.lit(1))
        part = F.substring(text(content), start, p["at"] + p["size"] + reach - start)
        return F.when(p["at"] > 0, shorten(part, width)).otherwise(F.lit(""))

    return let(let(F.struct(F.lower(text(content)).alias("low"), lower_trim(query).alias("q")), place), around)


def excerpt(headings: Column, context: Column, content: Column, query: Column) -> Column:
    """What is shown of a source: headings in brackets, then of context and content the snippet, or the beginning where nothing of the query occurs."""

    def part(c: Column, width: int) -> Column:
        return let(snippet(c, query), lambda found: F.when(F.length(found) > 0, found).otherwise(shorten(text(c), width)))

    parts = F.array(F.coalesce(context_label(headings), F.lit("")), part(context, 140), part(content, 180))
    return F.trim(F.array_join(F.filter(parts, lambda x: F.length(x) > 0), " "))


def fingerprint(content: Column) -> Column:
    """SHA-1 of the content with unified line ends and without outer white space."""
    return F.sha1(strip(F.replace(text(content), F.lit("\r\n"), F.lit("\n"))).cast("binary"))


def quote(c: Column) -> Column:
    """Percent-encoding with only letters, digits and _.-~ left as they are."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def document_uri(store: Column, path: Column) -> Column:
    return F.concat(F.lit("local://"), store, F.lit("/"), quote(path))


def chunk_uri(uri: Column, number: Column) -> Column:
    return F.concat(uri, F.lit("#c"), F.lpad(number.cast("string"), 4, "0"))


def canonical_uri(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def uri_path(uri: Column) -> Column:
    """The path inside a local URI; empty for others."""
    rest = F.regexp_extract(canonical_uri(uri), r"^local://[^/]*/(.*)$", 1)
    return F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))


def cluster_key(parent: Column, path: Column, uri: Column) -> Column:
    """What chunks of one document share: its parent's key, else its path, else its URI."""
    first = F.when(F.length(F.trim(text(parent))) > 0, F.trim(parent)).when(F.length(F.trim(text(path))) > 0, path)
    other = F.when(F.length(uri_path(uri)) > 0, uri_path(uri)).otherwise(canonical_uri(uri))
    return F.lower(F.coalesce(first, other))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def folder_text(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/+", " "))


def alias_keys(names: Column) -> Column:
    """Every name with separators as single spaces, and the same without any."""
    spaced = F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(F.lower(text(n)), r"(?U)[\s._\-]+", " "))), lambda n: F.length(n) > 0)
    return F.array_distinct(F.concat(spaced, F.transform(spaced, lambda n: F.replace(n, F.lit(" "), F.lit("")))))


def wikilinks(c: Column) -> Column:
    """Targets of [[links]] without label and section; embeds do not count."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?<!!)\[{2}([^\]]+)\]{2}"), F.lit(1))
    targets = F.transform(found, lambda x: F.trim(F.substring_index(F.substring_index(x, "|", 1), "#", 1)))
    return F.array_distinct(F.filter(targets, lambda x: F.length(x) > 0))


def inline_tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?U)(?<![/\w])#(\w[-\w/]*)"), F.lit(1)))


def headings(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(r"(?m)^#{1,6}[ \t]+(.+)$"), F.lit(1)), F.trim)


def bigrams(c: Column) -> Column:
    """Pairs of neighbouring characters; single characters where there is no pair."""
    n = F.length(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, 2))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(pairs)


def language_tokens(c: Column, language: str) -> Column:
    """Words by white space; character pairs of them for languages that put none between words."""
    words = F.filter(F.split(lower_trim(c), _SPACE), lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, bigrams)) if language in ("zh", "ja") else words


#: Words without meaning of their own, by language; others take the English ones.
STOPWORDS = {
    "en": "a be of an in on do to or as is at it by and the are who for has was get not but how find were have with will from been does this that what could would where about should search".split(),
    "de": "im an in es zu und die sie auf ich bei dem den ein von der für das des als mit ist eine auch einer nicht".split(),
    "fr": "la de le se il en un et au du une que qui par sur pas des les ils est avec elle pour dans nous vous".split(),
    "es": "o y la ya de le se al el en un lo no es su una que del con por las los sus para como pero".split(),
    "ko": "가 것 과 그 는 도 등 때 로 를 만 및 수 에 와 은 을 의 이 저 없다 있다 하다 어떤 그런 이런 으로 에서".split(),
    "ja": "い が さ し た て で と な に の は も や れ を ない なっ こと など この ため から ある いる する れる として".split(),
    "zh": "一 上 不 也 了 人 会 你 到 去 和 在 好 就 很 我 是 有 的 看 着 要 说 这 都 一个 自己 没有".split(),
}


def without_stopwords(words: Column, language: str = "en") -> Column:
    stop = F.array(*(F.lit(w) for w in STOPWORDS.get(language, STOPWORDS["en"])))
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def keywords(query: Column, language: str = "en") -> Column:
    """Words of the query that carry meaning; marks are dropped out of words, so a:b becomes ab."""
    words = F.transform(language_tokens(query, language), lambda w: F.regexp_replace(w, r"(?U)[^\w\-]", ""))
    return F.filter(without_stopwords(words, language), lambda w: F.length(w) > 1)


#: By the word meant: spellings of it that are put right. Words that stand for themselves count as corrections, too.
_MEANT = {"python": "pythn pyton pythno", "document": "documnet", "file": "flie", "search": "serach", "configuration": "configurtion", "important": "importent", **{w: w for w in "config pdf docx xlsx json".split()}}
TYPOS = {typo: word for word, typos in _MEANT.items() for typo in typos.split()}


def correct(words: Column, typos: dict[str, str] = TYPOS) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in typos.items() for x in kv))
    return F.transform(words, lambda w: F.coalesce(F.element_at(pairs, w), w))


EXTENSIONS = "pdf docx doc txt md py js ts java cpp c go rs html css json xml yaml yml csv xlsx pptx rtf tex".split()


def extensions(query: Column) -> Column:
    """Known file extensions named with or without a dot, sorted."""
    low = F.lower(text(query))
    dotted = F.regexp_extract_all(low, F.lit(r"\.([a-z0-9]+)"), F.lit(1))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0))
    known = F.array(*(F.lit(e) for e in EXTENSIONS))
    return F.array_sort(F.array_intersect(known, F.array_union(dotted, words)))


def edit_distance(a: Column, b: Column) -> Column:
    """Letters to insert, delete or replace between two words."""
    return F.levenshtein(text(a), text(b))


def tokens_of_bytes(n: Column) -> Column:
    """Four bytes to a token."""
    return F.floor(F.coalesce(n, F.lit(0)) / 4).cast("long")


def uptime(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, from the largest that is not zero on."""
    s = F.floor(seconds).cast("long")
    units = ((s / 86400, "d"), (s % 86400 / 3600, "h"), (s % 3600 / 60, "m"), (s % 60, "s"))
    named = F.array(*(F.concat(F.floor(n).cast("string"), F.lit(u)) for n, u in units))
    first = F.when(s >= 86400, 1).when(s >= 3600, 2).when(s >= 60, 3).otherwise(4)
    return F.array_join(F.slice(named, first, F.lit(4)), " ")


def query_filters(query: Column) -> Column:
    """Filters written into a query: size with comparison, value and unit (bytes where none is named), dates and type; null where absent."""
    low = F.lower(text(query))

    def part(pattern: str, group: int) -> Column:
        found = F.regexp_extract(low, pattern, group)
        return F.when(F.length(found) > 0, found)

    size = r"size:\s*([<>]=?|=)?\s*(\d+(?:\.\d+)?)\s*(tb|gb|mb|kb|b)?"
    return F.struct(
        F.when(part(size, 2).isNotNull(), F.coalesce(part(size, 1), F.lit("="))).alias("size_op"),
        part(size, 2).cast("double").alias("size_value"),
        F.when(part(size, 2).isNotNull(), F.upper(F.coalesce(part(size, 3), F.lit("b")))).alias("size_unit"),
        *(part(name + r":\s*(\d{4}(?:-\d{2}){2})", 1).alias(name) for name in ("after", "before")),
        part(r"type:\s*([a-z0-9]+)", 1).alias("type"),
    )


def expand(words: Column, synonyms: dict[str, list[str]], limit: int = 6) -> Column:
    """Synonyms of the words that are not among them, in order, at most `limit`."""
    if not synonyms:
        return F.array().cast("array<string>")
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in v)))))
    found = F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), F.array().cast("array<string>"))))
    return F.slice(F.array_except(found, words), 1, limit)


def cache_key(query: Column, store: Column, **options: Column) -> Column:
    """SHA-256 of query, store and the options that are set, in the order of their names."""
    parts = [query, store, *(F.concat(F.lit(f"{k}="), options[k].cast("string")) for k in sorted(options))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def context_label(headings: Column) -> Column:
    return F.when(F.size(headings) > 0, F.concat(F.lit("["), F.array_join(headings, " > "), F.lit("]")))


def contextual(headings: Column, content: Column, context: Column | None = None, blank: bool = False) -> Column:
    """Headings, context and passage of a document or chunk, each labelled, with blank lines between; blank: a passage without text has its label, too."""
    head = F.when(F.size(headings) > 0, F.concat(F.lit("[Headings] "), F.array_join(headings, " > ")))
    around = F.when(F.length(strip(text(context))) > 0, F.concat(F.lit("[Context]\n"), strip(context))) if context is not None else F.lit(None).cast("string")
    body = strip(text(content))
    label = F.when(head.isNotNull() | around.isNotNull(), F.lit("[Passage]\n")).otherwise(F.lit(""))
    return F.concat_ws("\n\n", head, around, F.when(F.lit(blank) | (F.length(body) > 0), F.concat(label, body)))


def fielded(title: Column, headings: Column, aliases: Column, tags: Column, links: Column, content: Column) -> Column:
    """What the index reads: the title three times, the headings twice, names, tags, links and the passage."""

    def joined(c: Column, mark: str = " ") -> Column:
        out = F.array_join(F.filter(c, lambda x: F.length(F.trim(x)) > 0), mark)
        return F.when(F.length(out) > 0, out)

    name = F.when(F.length(F.trim(text(title))) > 0, F.trim(title))
    head = joined(headings, " | ")
    return F.concat_ws("\n", name, name, name, head, head, joined(aliases), joined(tags), joined(links), contextual(headings, content, blank=True))


def estimated_tokens(c: Column) -> Column:
    """Three words to four tokens."""
    return (F.size(F.filter(F.split(text(c), _SPACE), lambda w: F.length(w) > 0)) / F.lit(0.75)).cast("int")


def age(seconds: Column) -> Column:
    """How long ago, for people."""
    return (
        F.when(seconds.isNull(), F.lit("Never"))
        .when(seconds < 3600, F.lit("Just now"))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB")))
    )
