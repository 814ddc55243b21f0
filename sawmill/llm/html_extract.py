"""Operator 4: main text by equivalence-class template deduction.

Tokens of a page are its containers (paths of tags with class and id words, digits folded) and its texts (a block
with its path). The occurrence vector of a token over a host's pages is never built: its signature is two sums
over pages of a hash of page and count, which partial aggregation adds up, so tokens of equal signature are those of
equal vectors. They form a class. A class is valid if it has `members` tokens or more and stands, once a page, on most of
the host's pages; its containers are slots, nested by their paths, and its texts are the template's own.

Then the slots are told apart by what fills them: the text of a menu or notice comes again on other pages, that of
an article does not. A slot whose texts repeat more than twice as often as the main slot's is boilerplate, named or not. The
main slot is the deepest one with most of the host's distinct text; an article or main element with half of it
goes first. Fixed lists of tags, roles and class words break ties alone: among texts that vary from page to
page they take out comments and adverts, unless nearly all varying text of the host stands in such containers.

Each page gives the blocks of its main slot that stand in no boilerplate slot and are no text of the template; a page
without that slot falls back on its article or main element, then its body.

Defined cases: null or empty html gives an empty text; broken markup is read as browsers do in the main
(unclosed p, li, td and tr end by themselves, a stray end tag is ignored, an unclosed comment runs to the
end); a null url belongs to the empty host; a host with one page is its own template; repeated rows are
pages of their own; blocks of equal text are all kept; nested markup of any depth takes linear time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MASK, small_batches, table, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BREAKS = frozenset({"hr"})
# What is never main text, by tag, by role and by words of class or id.
OUT_TAGS = frozenset("aside audio button canvas datalist dialog fieldset footer form head header iframe map math menu nav noscript object optgroup option select svg template video".split()) | RAW
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Never text, whatever the classes say.
HARD_TAGS = frozenset("button canvas datalist head iframe map math noscript object optgroup option select svg template video audio".split()) | RAW
KEEP_TAGS = frozenset("html body main article".split())
CONTAINERS = frozenset("article aside body center dialog div fieldset footer form header main menu nav ol section table tbody td tr ul".split())
#: Levels of containers that can be slots.
LEVELS = 64
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _kind(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The token of an element, whether its text never counts, and whether the lists name it boilerplate."""
    token, out, never = tag, tag in OUT_TAGS, tag in HARD_TAGS
    if attributes:
        found = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(attributes)}
        if found:
            named = " ".join(sorted(found.get("class", "").split())) + "#" + found.get("id", "")
            token += "." + re.sub(r"\d+", "0", named)
            role = found.get("role", "")
            if role == "main" or found.get("itemprop") == "articlebody":
                token += "!main"
            never = never or "hidden" in found or found.get("aria-hidden") == "true"
            # A comment in an article element is still a comment; html, body and main may name what they have beside them.
            out = out or role in OUT_ROLES or (tag not in KEEP_TAGS and not OUT_WORDS.isdisjoint(WORDS.findall(named))) or (tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(WORDS.findall(named)))
    return token, never or (out and tag in INLINE), out


class Page:
    """Elements and blocks of a page."""

    def __init__(self, source: str):
        self.elements: list[list] = []  # path, token, tag, containers on the way (own included), parent's index, never text, named boilerplate
        self.blocks: list[tuple[str, int]] = []  # text, element
        self.kinds: dict = {}
        self._read(source)

    def _read(self, source: str) -> None:
        stack, text, at, end = [], [], 0, len(source)  # stack: (tag, element, pieces of text before an inline element)
        elements, blocks, kinds = self.elements, self.blocks, self.kinds
        elements.append([0, "", "", (), -1, False, False])
        stack.append(("", 0, 0))

        def flush() -> None:
            if text:
                tag, here, before = stack[-1]
                if tag in INLINE:  # boilerplate within a line: what stood before it belongs to the line
                    del text[before:]
                    stack[-1], here = (tag, here, 0), elements[here][4]
                if not elements[here][5]:
                    block = SPACE.sub(" ", html.unescape("".join(text))).strip()
                    if block:
                        blocks.append((block, here))
                text.clear()

        def close(depth: int) -> None:
            if depth == len(stack) - 1 and stack[depth][0] in INLINE:
                del text[stack[depth][2] :]
            else:
                flush()
            del stack[depth:]

        find = TOKEN.search
        while at < end:
            m = find(source, at)
            if m is None:
                text.append(source[at:])
                break
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in INLINE or tag in VOID:
                    if tag in VOID or not any(x[0] == tag for x in stack[-8:]):
                        continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                continue
            key = (tag, m[3])
            if (kind := kinds.get(key)) is None:
                kind = kinds[key] = _kind(tag, m[3])
            token, never, out = kind
            if tag in RAW:
                stop = re.compile(f"</{tag}", re.I).search(source, at)
                at = end if stop is None else stop.start()
                if stop is not None:
                    shut = source.find(">", at)
                    at = end if shut < 0 else shut + 1
                continue
            if tag in VOID:
                if tag in BREAKS:
                    flush()
                else:
                    text.append(" " if tag == "br" else "")
                continue
            if tag in INLINE and not never:
                continue
            if tag not in INLINE:
                flush()
                if stack[-1][0] == "p":
                    close(len(stack) - 1)
                if tag in CLOSED_BY:
                    ends, limits = CLOSED_BY[tag]
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] in limits:
                            break
                        if stack[depth][0] in ends:
                            close(depth)
                            if stack[-1][0] not in ends:
                                break
            parent = stack[-1][1]
            path, slots = hash_path(elements[parent][0], token), elements[parent][3]
            if tag in CONTAINERS and len(slots) < LEVELS and not (never or elements[parent][5]):
                slots = (*slots, path)
            elements.append([path, token, tag, slots, parent, never or elements[parent][5], out or elements[parent][6]])
            stack.append((tag, len(elements) - 1, len(text)))
        flush()


def hash_path(parent: int, token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace"), seed=parent & ((1 << 63) - 1)) - (1 << 63)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each token of each page. text: whether it is a text; slot: its path or that of the container it stands in."""
    for batch in batches:
        out = []
        for host, key, source in zip(batch["host"], batch["page"], batch["html"], strict=True):
            page, seen = Page(source or ""), {}
            for path, token, tag, slots, _, never, named in page.elements:
                if not never and slots and slots[-1] == path:
                    own = seen.setdefault((False, path), [path, 0, 0, named, tag in ("article", "main") or token.endswith("!main"), slots])
                    own[1] += 1
            for text, at in page.blocks:
                e = page.elements[at]
                own = seen.setdefault((True, hash_path(e[0], text)), [e[3][-1] if e[3] else 0, 0, len(text), e[6], False, None])
                own[1] += 1
            for i, ((is_text, token), (slot, n, size, named, article, slots)) in enumerate(seen.items()):
                sign = hash_path(key, str(n)) & MASK
                out.append((host, token, is_text, slot, n, size, named, article, list(slots) if slots else None, sign >> 32, sign & 0xFFFFFFFF, int(i == 0)))
        yield pd.DataFrame(out, columns=["host", "token", "text", "slot", "n", "size", "named", "article", "slots", "sign1", "sign2", "first"])


TOKENS = "host long, token long, text boolean, slot long, n int, size int, named boolean, article boolean, slots array<long>, sign1 long, sign2 long, first int"


def host_key(url: str):
    return F.xxhash64(host_of(url))


def tokens(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The tokens of each host with their vectors' signatures (sign1, sign2, pages), written; a slot's texts that stand on one page are one row without token."""
    rows = pages.select(host_key(url_col).alias("host"), F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(html_col).cast("string").alias("html"))
    seen = rows.mapInPandas(_tokens, TOKENS)
    one = seen.groupBy("host", "text", "token").agg(
        F.first("slot").alias("slot"), F.first("size").alias("size"), F.max("named").alias("named"), F.max("article").alias("article"), F.max("slots").alias("slots"), F.sum("sign1").alias("sign1"),
        F.sum("sign2").alias("sign2"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum("first").alias("first"),
    )
    key = F.when(~F.col("text") | (F.col("pages") > 1), F.col("token"))
    some = one.withColumn("token", key).groupBy("host", "text", "slot", "named", "token").agg(
        F.max("article").alias("article"), F.max("slots").alias("slots"), F.sum("sign1").alias("sign1"), F.sum("sign2").alias("sign2"), F.max("pages").alias("pages"), F.max("once").alias("once"),
        F.sum("size").cast("double").alias("distinct"), F.sum(F.col("size").cast("double") * F.col("n")).alias("chars"), F.sum("first").alias("first"),
    )
    return written(some, "tokens")


def classes(found: DataFrame, members: int = 2) -> DataFrame:
    """host, token, text, slot, slots, article, pages, class_id of the tokens in valid classes; host_pages: the host's pages that have tokens."""
    counts = found.groupBy("host").agg(F.sum("first").alias("host_pages"))
    one = Window.partitionBy("host", "sign1", "sign2", "pages")
    valid = found.filter("token is not null").withColumn("members", F.count(F.lit(1)).over(one)).join(counts, "host")
    # Pages without a token (null, empty or broken html) say nothing about the template.
    valid = valid.filter((F.col("members") >= members) & (2 * F.col("pages") > F.col("host_pages")) & (2 * F.col("once") > F.col("pages")))
    return valid.select("host", "token", "text", "slot", "slots", "article", "pages", "host_pages", F.xxhash64("sign1", "sign2", "pages").alias("class_id"))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", members: int = 2, most: float = 0.8, least: int = 5) -> DataFrame:
    """For each host (host_key): main (path of the main slot), named (whether the lists count), keep and drop (its slots), texts (of the template)."""
    small_batches(pages.sparkSession)
    found = tokens(pages, url_col, html_col)
    valid = written(classes(found, members), "classes")
    slots = valid.filter("not text").select("host", F.col("token").alias("path"), "article", F.size("slots").alias("depth"))
    slots = slots.union(found.select("host").distinct().select("host", F.lit(0).cast("long"), F.lit(False), F.lit(0)))
    # The slots that lie around each container, the deepest last.
    chains = found.filter("not text and token is not null").select("host", F.col("token").alias("of"), F.posexplode("slots").alias("pos", "path"))
    around = chains.join(slots.select("host", "path"), ["host", "path"]).groupBy("host", "of").agg(F.sort_array(F.collect_list(F.struct("pos", "path"))).alias("in"))
    texts = found.filter("text").select("host", F.col("slot").alias("of"), "named", "distinct", "chars")
    # The page as a whole (0) is the outermost slot of all.
    in_ = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(F.col("in.path"), F.array().cast("array<long>"))).alias("in")
    placed = texts.join(around, ["host", "of"], "left").groupBy("host", in_).agg(
        F.sum("distinct").alias("distinct"), F.sum("chars").alias("chars"), F.sum(F.when(~F.col("named"), F.col("distinct")).otherwise(0.0)).alias("free"), F.sum(F.when(~F.col("named"), F.col("chars")).otherwise(0.0)).alias("free_chars")
    )
    placed = written(placed, "placed")
    totals = placed.groupBy("host").agg(F.sum("distinct").alias("all"), F.sum("free").alias("all_free")).withColumn("lists", F.col("all_free") >= (1 - most) * F.col("all"))
    within = placed.select("host", F.explode("in").alias("path"), "distinct", "free", "chars", "free_chars").groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("distinct", "free", "chars", "free_chars")])
    each = within.join(totals, "host").join(slots, ["host", "path"])
    own = F.when(F.col("lists"), F.col("free")).otherwise(F.col("distinct"))
    share = own / F.when(F.col("lists"), F.col("all_free")).otherwise(F.col("all"))
    rank = F.when(F.col("article") & (share >= 0.5), 0).when(share >= most, 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), F.when(rank == 0, -own).otherwise(-F.col("depth")).alias("o"), "path", (own / F.when(F.col("lists"), F.col("free_chars")).otherwise(F.col("chars"))).alias("fresh"))).alias("m")
    main = each.filter(own > 0).groupBy("host").agg(best).filter("m.rank < 2").select("host", F.col("m.path").alias("main"), F.col("m.fresh").alias("fresh"))
    # Slots by the texts that stand in them and in no deeper slot.
    counts = found.groupBy("host").agg(F.sum("first").alias("host_pages"))
    direct = placed.select("host", F.element_at("in", -1).alias("path"), "distinct", "chars").groupBy("host", "path").agg(F.sum("distinct").alias("distinct"), F.sum("chars").alias("chars"))
    told = slots.select("host", "path").join(direct, ["host", "path"], "left").join(main, "host").join(counts, "host")
    told = told.withColumn("again", F.coalesce((F.col("host_pages") >= least) & (F.col("path") != F.col("main")) & (2 * F.col("distinct") < F.col("fresh") * F.col("chars")), F.lit(False)))
    sides = told.groupBy("host").agg(F.collect_list(F.when(~F.col("again"), F.col("path"))).alias("keep"), F.collect_list(F.when(F.col("again"), F.col("path"))).alias("drop"))
    said = valid.filter("text").join(main, "host").filter((F.col("host_pages") >= least) & (2 < F.col("fresh") * F.col("pages"))).groupBy("host").agg(F.collect_list("token").alias("texts"))
    return totals.select("host", F.col("lists").alias("named")).join(main.drop("fresh"), "host", "left").join(sides, "host", "left").join(said, "host", "left")


def main_text(source: str | None, main: int | None = None, named: bool = True, keep: frozenset = frozenset(), drop: frozenset = frozenset(), texts: frozenset = frozenset()) -> str:
    """The blocks of a page's main slot without boilerplate slots and the template's texts; a slot that holds nothing else keeps them."""
    if not source:
        return ""
    page = Page(source)
    inside = [False] * len(page.elements)

    def mark(test) -> bool:
        found = False
        for i, e in enumerate(page.elements):
            inside[i] = not e[5] and not (named and e[6]) and (test(e) or (e[4] >= 0 and inside[e[4]]))
            found |= inside[i]
        return found

    if not (
        (main is not None and mark(lambda e: e[0] == main and e[4] >= 0))
        or mark(lambda e: e[2] == "article" or e[1].endswith("!main"))
        or mark(lambda e: e[2] == "main")
    ):
        mark(lambda e: e[4] < 0)
    own = [(text, at) for text, at in page.blocks if inside[at]]
    if not (drop or texts):
        return "\n".join(text for text, _ in own)
    boiler: dict = {}

    def repeated(at: int) -> bool:
        slots = page.elements[at][3]
        if slots not in boiler:
            boiler[slots] = next((x in drop for x in reversed(slots) if x in drop or x in keep), False)
        return boiler[slots]

    varying = [x for x in own if not repeated(x[1]) and hash_path(page.elements[x[1]][0], x[0]) not in texts]
    return "\n".join(text for text, _ in varying or own)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_slots: int = 200_000, **options) -> DataFrame:
    """Every column of pages but the html, with text and n_chars. options: of templates."""
    small_batches(pages.sparkSession)
    found = templates(pages, url_col, html_col, **options)
    parts = ["__main", "__named", "__keep", "__drop", "__texts"]
    of_host = written(found.select(F.col("host").alias("__host"), *[F.col(p[2:]).alias(p) for p in parts]), "templates")
    # Hosts with their slots and texts: all are sent.
    size = F.sum(1 + sum((F.coalesce(F.array_size(p), F.lit(0)) for p in parts[2:]), F.lit(0)))
    if (of_host.agg(size).first()[0] or 0) <= broadcast_slots:
        of_host = F.broadcast(of_host)

    def run(source: pd.Series, main: pd.Series, named: pd.Series, *sets: pd.Series) -> pd.Series:
        known: dict = {}

        def frozen(x) -> frozenset:
            if x is None or not len(x):
                return frozenset()
            raw = x.tobytes()
            return known.get(raw) or known.setdefault(raw, frozenset(x.tolist()))

        return pd.Series([main_text(s, None if pd.isna(m) else int(m), bool(n) or pd.isna(n), *map(frozen, x)) for s, m, n, *x in zip(source, main, named, *sets, strict=True)], dtype=object)

    from pyspark.sql.types import StringType

    joined = pages.withColumn("__of", host_key(url_col)).join(of_host.withColumn("__main", F.col("__main").cast("string")), F.col("__of") == F.col("__host"), "left")
    text = F.pandas_udf(run, StringType())(F.col(html_col).cast("string"), *[F.col(p) for p in parts])
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return joined.select(*kept, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
