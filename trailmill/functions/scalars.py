"""Column functions: hashes and ids, URLs, dates, texts, JSON, vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of URLs for name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def hash16(value: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substr(F.sha2(value, 256), F.lit(1), F.lit(16))


def uuid5(value: Column) -> Column:
    """The name-based UUID (version 5) of a text in the name space of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(value, "UTF-8")))
    at = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    variant = F.lower(F.conv((F.conv(at(17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def hash_number(scope: str, key: Column) -> Column:
    """A number below 2**48 from a scope and a key."""
    return F.conv(F.substr(F.sha2(F.concat(F.lit(scope), F.decode(F.unhex(F.lit("00")), "UTF-8"), key), 256), F.lit(1), F.lit(12)), 16, 10).cast("long")


def fnv1a(value: Column) -> Column:
    """FNV-1a of 32 bits over the characters, as 8 hex digits."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lpad(F.lower(F.hex(F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step))), 8, "0")


def content_id(content: Column, suffix: str) -> Column:
    return F.concat(F.substr(F.sha2(content, 256), F.lit(1), F.lit(24)), F.lit(suffix))


def keyed_id(key: bytes):
    """A function of columns: an id from HMAC-SHA256 under a key that stays in the closure and out of plans."""

    @F.pandas_udf("string")
    def pseudonym(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hmac
        import uuid

        for v in values:
            yield v.map(lambda x: None if x is None else str(uuid.UUID(bytes=hmac.digest(key, str(x).encode(), "sha256")[:16])))

    return pseudonym


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def query_parameter(url: Column, name: str) -> Column:
    """The decoded first value of a parameter; empty if there is none."""
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def product_slug(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.rtrim(url_path(url), F.lit("/"))), r"/products/([^/?]*)", 1)


def normal_handle(handle: Column) -> Column:
    """Lower case, no query, fragment or closing slash."""
    return F.rtrim(F.regexp_replace(F.lower(F.trim(handle)), r"[?#].*$", ""), F.lit("/"))


#: Subtrees that are one page class, and what is no page: places of assets, endings of files.
TEMPLATE_PREFIXES = ("/products/", "/collections/", "/policies/", "/blogs/", "/account/")
PAGES_PREFIX = "/pages/"
ASSET_PREFIXES = ("/fast-image/", "/cdn/")
FILE_SUFFIXES = (".xml", ".json", ".txt", ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico")


def template_path(path: Column, collapse: Column | None = None) -> Column:
    """The class of a page by its path, without query and fragment: everything below a template prefix is one class.

    Pages keep their path, unless what follows /pages/ (no closing slashes) is in
    the array `collapse`. An empty path is /.
    """

    def of(bare: Column) -> Column:
        out = F.when(bare == "", "/")
        for p in TEMPLATE_PREFIXES:
            out = out.when(bare.startswith(p) & (F.length(bare) > len(p)), p + "<*>")
        if collapse is not None:
            rest = F.rtrim(F.substr(bare, F.lit(len(PAGES_PREFIX) + 1)), F.lit("/"))
            out = out.when(bare.startswith(PAGES_PREFIX) & (rest != "") & F.coalesce(F.array_contains(collapse, rest), F.lit(False)), PAGES_PREFIX + "<*>")
        return out.otherwise(bare)

    return let(F.regexp_replace(F.coalesce(path, F.lit("")), r"(?s)[?#].*$", ""), of)


_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _url_parts(url: Column) -> list[Column]:
    """Scheme in small letters, host with port, path, query and fragment; '' for what is not there."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    return [F.lower(part(1)), *[part(k) for k in range(2, 6)]]


def _without_dots(segments: Column) -> Column:
    """Segments of a path with . and .. carried out; both at the end leave an empty one."""
    one = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    done = F.aggregate(segments, F.array().cast("array<string>"), one)
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)


def let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def resolve_link(base: Column, link: Column) -> Column:
    """The absolute URL of a link on the page `base`, by the rules of relative references; links of another scheme stay as they are."""
    parts = lambda url: F.struct(*[c.alias(n) for n, c in zip("shpqf", _url_parts(url), strict=True)])

    def path_of(b: Column, x: Column) -> Column:
        """The link's path on the way from the base's folder; empty segments count at both ends only."""
        folder = let(F.split(b["p"], "/"), lambda f: F.when(F.element_at(f, -1) != "", F.slice(f, F.lit(1), F.size(f) - 1)).otherwise(f))
        inner = lambda j: F.filter(F.slice(j, F.lit(2), F.greatest(F.size(j) - 2, F.lit(0))), lambda y: y != "")
        tidy = lambda j: F.when(F.size(j) > 2, F.concat(F.slice(j, F.lit(1), F.lit(1)), inner(j), F.slice(j, F.size(j), F.lit(1)))).otherwise(j)
        joined = F.when(x["p"].startswith("/"), F.split(x["p"], "/")).otherwise(let(F.concat(folder, F.split(x["p"], "/")), tidy))
        return let(F.array_join(let(joined, _without_dots), "/"), lambda t: F.when(t == "", "/").otherwise(t))

    def joined(b: Column, x: Column) -> Column:
        host = F.when(x["h"] != "", x["h"]).otherwise(b["h"])
        path = F.when(x["h"] != "", x["p"]).when(x["p"] == "", b["p"]).otherwise(path_of(b, x))
        query = F.when((x["h"] == "") & (x["p"] == "") & (x["q"] == ""), b["q"]).otherwise(x["q"])
        rooted = lambda t: F.when((host != "") & (t != "") & ~t.startswith("/"), F.concat(F.lit("/"), t)).otherwise(t)
        asked = let(query, lambda t: F.when(t != "", F.concat(F.lit("?"), t)).otherwise(""))
        return F.concat(b["s"], F.when(b["s"] != "", ":").otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), let(path, rooted), asked, F.when(x["f"] != "", F.concat(F.lit("#"), x["f"])).otherwise(""))

    both = let(F.struct(parts(base).alias("b"), parts(link).alias("x")), lambda v: F.when((v["x"]["s"] != "") & (v["x"]["s"] != v["b"]["s"]), link).otherwise(joined(v["b"], v["x"])))
    return F.when(base.isNull() | link.isNull(), F.lit(None).cast("string")).when(link == "", base).when(base == "", link).otherwise(both)


def canonical_link(base: Column, link: Column, collapse: Column | None = None) -> Column:
    """(canonical, url, path) of a link that leads to a page of the base's host, else null.

    Only http and https, the same host and port, no asset, no file, no colon in the
    path. canonical is the class of the page, url the page without query and
    fragment.
    """

    def page(v: Column) -> Column:
        path, low = v["path"], F.lower(v["path"])
        ok = v["s"].isin("http", "https") & (v["h"] == v["own"]) & ~path.contains(":")
        ok = functools.reduce(lambda a, x: a & ~path.startswith(x), ASSET_PREFIXES, ok)
        ok = functools.reduce(lambda a, x: a & ~low.endswith(x), FILE_SUFFIXES, ok)
        return F.when(ok, F.struct(template_path(path, collapse).alias("canonical"), F.concat(v["s"], F.lit("://"), v["h"], path).alias("url"), path.alias("path")))

    def parted(full: Column) -> Column:
        s, h, p, _, _ = _url_parts(full)
        return let(F.struct(s.alias("s"), h.alias("h"), F.when(p == "", "/").otherwise(p).alias("path"), _url_parts(base)[1].alias("own")), page)

    return F.when(F.trim(link) != "", let(resolve_link(base, F.trim(link)), parted))


def admissible_link(base: Column, link: Column) -> Column:
    """Whether a link leads to a page of the base's host."""
    return canonical_link(base, link).isNotNull()


def clock_ms(text: Column) -> Column:
    """Milliseconds of mm:ss or hh:mm:ss; null for anything else."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 60 + p)
    return F.when(F.size(parts).isin(2, 3), total * 1000)


def seconds_of(text: Column) -> Column:
    """Seconds of a number or an ISO time; null if it is neither."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def html_text():
    """A function of columns: the text of HTML by a parser, entities resolved, scripts and styles left out."""

    @F.pandas_udf("string")
    def texts(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from html.parser import HTMLParser

        class Texts(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.out, self.skip = [], 0

            def handle_starttag(self, tag, attrs):
                self.skip += tag in ("script", "style")

            def handle_endtag(self, tag):
                self.skip -= tag in ("script", "style") and self.skip > 0

            def handle_data(self, data):
                if not self.skip:
                    self.out.append(data)

        def one(html):
            if html is None:
                return None
            p = Texts()
            p.feed(html)
            p.close()
            return " ".join(" ".join(p.out).split())

        for v in values:
            yield v.map(one)

    return texts


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def unescaped():
    """A function of an array of texts: their HTML character references as characters."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        from html import unescape

        return texts.map(lambda some: None if some is None else [None if x is None else unescape(x) for x in some])

    return run


def semantic_ids(html: Column) -> Column:
    """The distinct semantic ids of a page, sorted: parser- or data- attributes in any case, unescaped, without blanks around; blank ones go."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(?:parser|data)-semantic-id\s*=\s*(['\"])(.*?)\1"), F.lit(2))
    there = F.filter(raw, lambda x: F.regexp_like(x, F.lit(r"(?U)\S")))
    return F.array_sort(F.array_distinct(F.transform(unescaped()(there), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))


def click_text(elements: Column) -> Column:
    """The text of what was clicked, from an elements chain, without blanks around it."""
    return F.trim(F.regexp_extract(elements, r'text="([^"]*)"', 1))


def index_list(spec: Column) -> Column:
    """The numbers of a list like 0,1,10-15, ranges with both ends, in the order given and once each; blanks are skipped."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int"))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(F.element_at(ends(p), -1) >= ends(p)[0], F.sequence(ends(p)[0], F.element_at(ends(p), -1))).otherwise(F.array().cast("array<int>")))))


def tokens(text: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct words of letters and digits in lower case, without stop words and short ones."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= least), F.array(*[F.lit(x) for x in stop]))


def generated_action(text: Column) -> Column:
    """(action, target) of a model's JSON answer, flat or under `action`; nulls where it is no such object."""
    j = F.try_parse_json(text)
    get = lambda path: F.try_variant_get(j, path, "string")
    return F.struct(F.coalesce(get("$.action.action"), F.when(F.try_variant_get(j, "$.action", "struct<action string>").isNull(), get("$.action"))).alias("action"), F.coalesce(get("$.action.target"), get("$.target")).alias("target"))


def strict_json(text: Column) -> Column:
    """A text that is one JSON value as VARIANT, else null. The parser passes over what follows a value, so the text must also stand inside a list and inside an object."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull() & keyed.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


#: The actions that an answer may name, those that need a target, and directions of a scroll.
ALLOWED_ACTIONS = ("click", "type", "hover", "move", "select", "clear", "key_press", "scroll", "goto_url", "back", "forward", "refresh", "new_tab", "switch_tab", "close_tab", "terminate")
TARGET_ACTIONS = ("click", "type")
DIRECTIONS = ("up", "down")


def answer_field(answer: Column, name: str) -> Column:
    """The text of a field of a JSON answer (VARIANT); null if it is missing or no text."""
    v = F.try_variant_get(answer, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def valid_answer(text: Column) -> Column:
    """Whether a whole text is one JSON object of the next-action schema: a rationale, an allowed action, and the fields that the action needs, of their kinds.

    Fields that the action does not ask for may be anything. A name that stands
    twice makes the text no JSON.
    """

    def of(j: Column) -> Column:
        kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(j, f"$.{name}", "variant")), F.lit("none"))
        text_of = lambda name: kind(name) == "STRING"
        free = lambda name, ok: (kind(name) == "none") | ok
        whole = lambda name: kind(name) == "BIGINT"
        number = lambda name: whole(name) | kind(name).startswith("DECIMAL") | (kind(name) == "DOUBLE")
        action = F.coalesce(answer_field(j, "action"), F.lit(""))
        needs = (
            F.when(action == "type", text_of("target") & text_of("text") & free("enter", kind("enter") == "BOOLEAN"))
            .when(action.isin(*TARGET_ACTIONS), text_of("target"))
            .when(action == "select", text_of("value"))
            .when(action == "key_press", text_of("key") & free("target", text_of("target")))
            .when(action == "scroll", F.coalesce(answer_field(j, "direction").isin(*DIRECTIONS), F.lit(False)) & number("amount") & free("target", text_of("target")))
            .when(action.isin("goto_url", "new_tab"), text_of("url"))
            .when(action.isin("switch_tab", "close_tab"), whole("tab_id"))
            .otherwise(True)
        )
        return F.schema_of_variant(j).startswith("OBJECT") & text_of("rationale") & action.isin(*ALLOWED_ACTIONS) & needs

    return F.coalesce(let(strict_json(text), of), F.lit(False))


def answer_components(text: Column, action: Column, target: Column, page: Column, similarity) -> Column:
    """(format, action, target): what an answer earns against the true action and target on a page.

    target is 0.6 times the similarity (a function of two columns) of both targets,
    0.1 for one that the page has, 0.3 for the right one; missing texts are ''. A
    text that is no JSON object has no action and no target.
    """
    j = strict_json(text)
    obj = F.coalesce(F.schema_of_variant(j).startswith("OBJECT"), F.lit(False))
    said = lambda name: F.when(obj, F.coalesce(F.try_variant_get(j, f"$.{name}", "string"), F.lit(""))).otherwise("")
    true_action, true_target = (F.coalesce(c, F.lit("")) for c in (action, target))
    aim = said("target")
    there = (aim != "") & F.array_contains(semantic_ids(page), aim)
    score = 0.6 * similarity(aim, true_target) + 0.1 * there.cast("int") + 0.3 * (aim == true_target).cast("int")
    return F.struct(valid_answer(text).cast("double").alias("format"), ((true_action != "") & (said("action") == true_action)).cast("double").alias("action"), score.alias("target"))


def has_exact_keys(text: Column, keys: list[str]) -> Column:
    """Whether a text is a JSON object with these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def store_of(explicit: Column, *candidates: Column) -> Column:
    """The explicit store, else the number at the end of the first candidate that has one."""
    tail = [F.nullif(F.regexp_extract(c, r"-(\d+)$", 1), F.lit("")) for c in candidates]
    return F.coalesce(F.nullif(explicit, F.lit("")), *tail)


def labelled_text(parts: dict[str, Column]) -> Column:
    """`Label: value, …` of the values that are not blank."""
    return F.concat_ws(", ", *[F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector counts as of length one."""
    norm = lambda v: F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))


def first_n_distinct(values: Column, n: int, most: int) -> Column:
    """The first n texts that differ in lower case, each cut to `most` characters."""
    seen = F.aggregate(values, F.array().cast("array<string>"), lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.concat(s, F.array(x))))
    return F.transform(F.slice(seen, 1, n), lambda x: F.substr(x, F.lit(1), F.lit(most)))


def any_of(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, columns)
