"""Change detection, upserts, frontiers, backfills, links, redirects and text scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.replies import let
from corpusloom.functions.urls import canonical_url, content_hash
from corpusloom.sources.scratch import cut


def change_classes(fetched: DataFrame, stored: DataFrame, domain: str = "example.org") -> DataFrame:
    """``seq, raw_url, url, change, new_hash`` of each fetched row (``raw_url, http_status, body, seq``) against the stored hashes (``url, content_hash``).

    invalid (no canonical url), duplicate (not the first of its url in the batch), no_content_item
    (404, 410), error (any other status but 200), new, changed, unchanged. Rows without a url are
    kept out of the shuffle, and the first of each url is combined before it.
    """
    own = fetched.withColumns({"url": canonical_url(F.col("raw_url"), domain), "new_hash": content_hash(F.col("body"))})
    bad = own.where("url IS NULL").select("seq", "raw_url", "url", F.lit("invalid").alias("change"), "new_hash")
    good = own.where("url IS NOT NULL")
    first = good.groupBy("url").agg(F.min("seq").alias("first"))
    met = good.join(first, "url").join(stored.select("url", F.col("content_hash").alias("old"), F.lit(True).alias("held")), "url", "left")
    change = (
        F.when(F.col("seq") > F.col("first"), "duplicate")
        .when(F.col("http_status").isin(404, 410), "no_content_item")
        .when(F.col("http_status") != 200, "error")
        .when(F.col("held").isNull(), "new")
        .when(F.col("old").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("changed")
    )
    return met.select("seq", "raw_url", "url", change.alias("change"), "new_hash").union(bad)


def upsert_pages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merge ``new`` (``url, content_hash, source, seen_at``) into ``stored``.

    first_seen stays, last_seen moves, last_changed moves when the hash differs, a null source
    leaves the old one.
    """
    n = new.select("url", F.col("content_hash").alias("h"), F.col("source").alias("s"), F.col("seen_at").alias("t"))
    changed = F.col("t").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("h"))
    return stored.join(n, "url", "full_outer").select(
        "url",
        F.when(F.col("t").isNotNull(), F.col("h")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.coalesce("s", "source").alias("source"),
        F.coalesce("first_seen", "t").alias("first_seen"),
        F.coalesce("t", "last_seen").alias("last_seen"),
        F.when(changed, F.col("t")).otherwise(F.col("last_changed")).alias("last_changed"),
    )


def frontier_classes(sitemap: DataFrame, stored: DataFrame) -> DataFrame:
    """``url, change``: new, updated (other lastmod; null equals empty) or unchanged."""
    old = stored.select("url", F.coalesce("lastmod", F.lit("")).alias("old"), F.lit(True).alias("held"))
    change = F.when(F.col("held").isNull(), "new").when(F.coalesce("lastmod", F.lit("")) != F.col("old"), "updated").otherwise("unchanged")
    return sitemap.join(old, "url", "left").select("url", change.alias("change"))


def to_fetch(sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier urls that are absent, without a hash, or listed as changed later than last seen."""
    own = pages.select("url", "content_hash", "last_seen", F.lit(True).alias("held"))
    due = F.col("held").isNull() | F.col("content_hash").isNull() | (F.col("lastmod") > F.col("last_seen"))
    return sitemap.join(own, "url", "left").where(due).select("url")


def stalest(pages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages to look at again."""
    return pages.where("content_hash IS NOT NULL").orderBy(F.col("last_seen").asc_nulls_first(), "url").limit(n)


def missing_children(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct linked pages that the corpus does not hold."""
    return links.select(F.col("child").alias("url")).distinct().join(pages.select("url"), "url", "left_anti")


#: A link with its target and what it shows; fixed value.
LINK = r'(?is)<a\b[^>]*?href="([^"]+)"[^>]*>(.*?)</a>'


def body_links(blobs: Column, domain: str = "example.org", limit: int = 500) -> Column:
    """Links of HTML texts (an array) as an array of ``href, text, external``, each target once, in order.

    Targets that begin with ``/`` are made absolute on ``domain``; anchors, queries, mail, phone
    and script links are skipped. The text is at most 200 characters, the target where there is
    none. At most ``limit`` a page, which is part of the feature.
    """
    pairs = F.flatten(F.transform(F.coalesce(blobs, F.array().cast("array<string>")), lambda b: F.arrays_zip(F.regexp_extract_all(F.coalesce(b, F.lit("")), F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(F.coalesce(b, F.lit("")), F.lit(LINK), F.lit(2)).alias("text"))))
    trimmed = F.transform(pairs, lambda p: F.struct(F.trim(p["href"]).alias("href"), F.trim(F.regexp_replace(p["text"], "<[^>]+>", "")).alias("text")))
    good = F.filter(trimmed, lambda p: ~p["href"].rlike(r"(?i)^(?:$|[#?]|mailto:|tel:|javascript:)"))
    whole = F.transform(good, lambda p: F.struct(F.when(p["href"].startswith("/"), F.concat(F.lit(f"https://www.{domain}"), p["href"])).otherwise(p["href"]).alias("href"), p["text"].alias("text")))
    foreign = r"(?i)^https?://(www\.)?" + domain.replace(".", r"\.")
    shown = lambda p: F.struct(p["href"].alias("href"), F.substring(F.coalesce(F.nullif(p["text"], F.lit("")), p["href"]), 1, 200).alias("text"), (~p["href"].rlike(foreign)).alias("external"))
    return F.transform(F.slice(let(whole, _first_of_each), 1, limit), shown)


def _first_of_each(links: Column) -> Column:
    """Of links to one target the first, in order: sorted by target and place, equal targets stand side by side."""
    keyed = F.array_sort(F.transform(links, lambda p, i: F.struct(p["href"].alias("href"), i.alias("at"), p["text"].alias("text"))))
    first = lambda all_: F.filter(all_, lambda p, i: (i == 0) | (F.try_element_at(all_, F.greatest(i, F.lit(1)))["href"] != p["href"]))
    return F.array_sort(F.transform(let(keyed, first), lambda p: F.struct(p["at"].alias("at"), p["href"].alias("href"), p["text"].alias("text"))))


def scrub(text: Column, names: Column, marker: str = "[organisation]") -> Column:
    """Replace the names in an array by a marker, longest first, without case."""
    ordered = F.array_sort(names, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).otherwise(1))
    quoted = F.transform(F.filter(ordered, lambda n: n != ""), lambda n: F.regexp_replace(n, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    return F.when(F.size(quoted) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)"), F.array_join(quoted, "|")), F.lit(marker))).otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty; else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def parent_type(payload: Column) -> Column:
    """Document type of the payload's parent, given as array or object; empty if there is none or the JSON is bad."""
    return first_filled(F.get_json_object(payload, "$.links.parent[0].document_type"), F.get_json_object(payload, "$.links.parent.document_type"))


def extract_fields(payload: Column, domain: str = "example.org") -> list[Column]:
    """Scalar fields of a payload; texts that are missing are empty, the content id and the destination null.

    A page is a redirect by its document type or its schema's name; its destination is that of the
    first redirect, canonical on ``domain``, null if it is foreign. An empty notice does not count
    as withdrawn. Bad JSON gives the fields of an empty payload.
    """
    get = lambda path: F.get_json_object(payload, path)
    text = lambda key: F.coalesce(get(f"$.{key}"), F.lit(""))
    to = get("$.redirects[0].destination")
    absolute = canonical_url(F.when(to.startswith("/"), F.concat(F.lit(f"https://www.{domain}"), to)).otherwise(to), domain)
    noticed = ~F.coalesce(get("$.withdrawn_notice"), F.lit("")).isin("", "{}", "[]", "false", "0")
    return [
        F.nullif(get("$.content_id"), F.lit("")).alias("content_id"),
        *[text(k).alias(k) for k in ("document_type", "schema_name", "title", "description", "first_published_at", "public_updated_at")],
        noticed.alias("withdrawn"),
        ((text("document_type") == "redirect") | (text("schema_name") == "redirect")).alias("is_redirect"),
        absolute.alias("destination"),
    ]


def redirect_chains(fetched: DataFrame, sources: DataFrame, max_depth: int = 10) -> DataFrame:
    """``src, final, http_status, hops, error`` of each of ``sources`` (``url``): where its chain of redirects ends.

    ``fetched`` has one row a url: ``url, http_status, is_redirect, destination`` (canonical, null
    if foreign or bad). error is null for a page, else circular, gone (410), not_found (404, or not
    in ``fetched``), external (no destination of ours), http_<status>, or max_depth. ``hops`` are
    the urls met. One join for each hop; no sources give no rows.
    """
    step = fetched.select(F.col("url").alias("at"), "http_status", "is_redirect", "destination")
    open_ = sources.select(F.col("url").alias("src"), F.col("url").alias("at"), F.array().cast("array<string>").alias("hops")).distinct()
    done = None
    for _ in range(max_depth + 1):
        met = open_.join(step, "at", "left").withColumn("again", F.array_contains("hops", F.col("at")))
        met = met.withColumn("hops", F.when(F.col("again"), F.col("hops")).otherwise(F.concat("hops", F.array("at"))))
        status = F.coalesce("http_status", F.lit(404))
        error = (
            F.when(F.col("again"), "circular")
            .when(status == 410, "gone")
            .when(status == 404, "not_found")
            .when(status != 200, F.concat(F.lit("http_"), status))
            .when(F.coalesce("is_redirect", F.lit(False)), F.when(F.col("destination").isNull(), "external").otherwise("open"))
        )
        met = cut(met.withColumns({"error": error, "http_status": status}))
        where = F.when(F.col("error").isNull() | F.col("error").isin("gone", "not_found"), F.col("at")).alias("final")
        seen = F.when(F.col("error").isNull() | (F.col("error") != "circular"), F.col("http_status")).alias("http_status")
        ended = met.where("error IS NULL OR error <> 'open'").select("src", where, seen, "hops", "error")
        done = ended if done is None else done.union(ended)
        open_ = met.where("error = 'open'").select("src", F.col("destination").alias("at"), "hops")
        if open_.isEmpty():
            return done
    none = F.lit(None)
    return done.union(open_.select("src", none.cast("string").alias("final"), none.cast("int").alias("http_status"), "hops", F.lit("max_depth").alias("error")))


# Patterns of e-mail addresses and phone numbers, terms that are always blocked, and the words shown.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\w)(?:\+?44\s?\d|0\d)(?:[\s\-]?\d){8,10}(?!\w)"
BLOCKED = ("fuck", "shit", "cunt")
FINDINGS = {"email": ("personal_data", "an email address (%s•••@%s•••)"), "phone": ("personal_data", "a phone number (•••%s)"), "term": ("prohibited_language", "language that is not permitted")}


def guardrail(text: Column, extra: list[str] = ()) -> Column:
    """The first finding in a user's text as ``kind, offending``; null if there is none.

    E-mail address, then phone number, then a blocked whole word. What is shown is masked: the
    first letters of name and host, the last two digits, nothing of a term. Null and empty texts
    have no finding.
    """
    mail, phone = F.regexp_extract(text, EMAIL, 0), F.regexp_extract(text, PHONE, 0)
    terms = sorted({t.strip().lower() for t in (*BLOCKED, *extra)} - {""})
    blocked = text.rlike(r"(?iuU)\b(?:" + "|".join(rf"\Q{t}\E" for t in terms) + r")\b")
    finding = lambda kind, shown: F.struct(F.lit(FINDINGS[kind][0]).alias("kind"), shown.alias("offending"))
    first = lambda part: F.substring(F.split_part(mail, F.lit("@"), F.lit(part)), 1, 1)
    digits = F.right(F.regexp_replace(phone, r"\D", ""), F.lit(2))
    return (
        F.when(mail != "", finding("email", F.format_string(FINDINGS["email"][1], first(1), first(2))))
        .when(phone != "", finding("phone", F.format_string(FINDINGS["phone"][1], digits)))
        .when(blocked, finding("term", F.lit(FINDINGS["term"][1])))
    )


#: Keys of a payload's date, the first filled one counts.
DATE_KEYS = ("public_updated_at", "public_timestamp", "updated_at", "first_published_at")


def payload_date(payload: Column) -> Column:
    """The payload's date by the order of ``DATE_KEYS``; empty if there is none or the JSON is bad."""
    return first_filled(*[F.get_json_object(payload, f"$.{k}") for k in DATE_KEYS])


def view_counts(pages: DataFrame, counts: DataFrame, today: str) -> DataFrame:
    """``url, view_count, view_count_source, view_count_updated`` of pages (with the same columns) after a collection.

    ``counts`` has ``path, views``. A page takes its own path's count, else its parent path's when
    the path has three segments or more; others, and those collected ``today``, keep what they have.
    """
    path = F.when(F.col("url").startswith("http"), F.regexp_replace("url", r"^https?://[^/]*", "")).otherwise(F.col("url"))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    parent = F.when(F.size(segments) >= 3, F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, F.size(segments) - 1), "/")))
    due = F.coalesce(F.col("view_count_updated") != today, F.lit(True))
    own = counts.select(F.col("path"), F.col("views").alias("own"))
    above = counts.select(F.col("path").alias("parent"), F.col("views").alias("inherited"))
    met = pages.withColumns({"path": path, "parent": parent}).join(own, "path", "left").join(above, "parent", "left")
    source = F.when(F.col("own").isNotNull(), "page").when(F.col("inherited").isNotNull(), "parent")
    new = due & source.isNotNull()
    pick = lambda value, name: F.when(new, value).otherwise(F.col(name)).alias(name)
    return met.select("url", pick(F.coalesce("own", "inherited"), "view_count"), pick(source, "view_count_source"), pick(F.lit(today), "view_count_updated"))
