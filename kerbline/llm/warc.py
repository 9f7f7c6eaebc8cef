"""WARC derivatives: metadata and plain-text conversion records linked to their responses. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.common import column, let

CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Elements whose content is no text, and elements that begin a line.
HIDDEN = ("script", "style", "noscript", "template")
LINES = ("address|article|aside|blockquote|body|br|caption|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|legend|li|main|nav|ol|"
         "option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul")
COMMENT = "(?s)<!--.*?(?:-->|$)"
UNSEEN = "(?is)<(?:!--.*?(?:-->|$)|(" + "|".join(HIDDEN) + ")(?:\\s[^>]*)?>[^<]*+(?:<(?!/\\1\\s*>)[^<]*+)*+(?:</\\1\\s*>|$))"
LINE_TAG = f"(?i)</?(?:{LINES})(?:[\\s/][^>]*)?>"
TAG = "(?:</?[A-Za-z][^>]*>|<[!?][^>]*>)"
TITLE = "(?is)<title(?:\\s[^>]*)?>(.*?)</title"
LINK = "(?i)<(a|area|base|form|iframe|img|link|script|source|video|audio|embed)\\s(?:[^>]*?\\s)?(href|src|action)\\s*=\\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\\s\"'>]+))"
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"

# Names of characters 160 to 255 in order, and further common names with their code points.
LATIN = ("nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 "
         "frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times "
         "Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde "
         "ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml").split()
NAMED = {"quot": 34, "amp": 38, "apos": 39, "lt": 60, "gt": 62, "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "sbquo": 8218, "ldquo": 8220, "rdquo": 8221,
         "bdquo": 8222, "bull": 8226, "hellip": 8230, "euro": 8364, "trade": 8482, "oelig": 339, "OElig": 338} | {n: 160 + i for i, n in enumerate(LATIN)}


def digest(data: Column) -> Column:
    """``sha1:`` and the SHA-1 of a string or binary in Base32."""
    hexed = F.sha1(data)

    def four(i: Column) -> Column:
        value = F.conv(F.substr(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])

    return F.concat(F.lit("sha1:"), *[four(F.lit(i)) for i in range(8)])


def record_id(kind: str, *parts: Column) -> Column:
    """A UUID URN made from its parts alone, so that a rerun gives the same one."""
    h = F.sha1(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _decoded(text: Column) -> Column:
    """Character references of ``text`` as characters; unknown names and impossible numbers stay. ``&amp;`` comes last."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def character(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2), F.char_length(ref) - 2)
        code = (F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10).cast("int")).when(body.startswith("#"), F.substr(body, F.lit(2)).cast("int"))
                .otherwise(F.try_element_at(names, body)))
        usable = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    others = F.filter(refs, lambda r: r != "&amp;")
    return F.when(F.instr(text, "&") > 0, F.replace(F.aggregate(others, text, lambda t, r: F.replace(t, r, character(r))), F.lit("&amp;"), F.lit("&"))).otherwise(text)


def _tidy(text: Column) -> Column:
    """Runs of blanks as one space, no blank lines, no blanks at the ends of lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\\t\\f\\x0B\\x{A0}]", " "), "  +", " "), " ?[\\r\\n]\\s*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """The text of a page: no comments, scripts and styles; block elements and breaks end lines; references decoded."""
    shown = F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), "[\\r\\n]+", " ")
    # Bound once: each further mention of an expression would compute it again.
    return let(F.regexp_replace(F.regexp_replace(shown, LINE_TAG, "\n"), TAG, ""), lambda text: _tidy(_decoded(text)))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of fetched pages: ``page_id, record_id, target_uri, date, headers, payload``.

    For archives, read the records instead; the columns are the same. ``headers`` is an array of ``(name, value)``. A null
    page has an empty payload.
    """
    payload = F.coalesce("html", F.lit(""))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    return pages.select("page_id", record_id("response", F.col("page_id"), F.col("url"), payload).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
                        F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", F.octet_length(payload).cast("string"))).alias("headers"),
                        payload.alias("payload"))


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per response: its identity and digests, and its metadata and conversion records, linked to it.

    Columns: the key, ``response_id, target_uri, date, payload_digest, block_digest`` (HTTP head and payload),
    ``metadata_id, metadata_refers_to, metadata`` (JSON: source headers, digest, length, title, links with element and
    attribute), ``metadata_digest, metadata_length, conversion_id, conversion_refers_to, text, text_digest, text_length``
    (bytes) and ``n_links``. An empty payload gives empty text, no title and no links; a null target stays null; repeated rows
    give the same records again. Nothing is shuffled.
    """
    payload = F.coalesce("payload", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")), F.lit(CRLF))), ""), F.lit(CRLF))
    found = (records.select(column(key), F.col("record_id").alias("response_id"), "target_uri", "date", "headers", payload.alias("payload"))
             .withColumn("payload_digest", digest(F.col("payload"))).withColumn("block_digest", digest(F.concat(head, F.col("payload"))))
             .withColumn("text", plain_text(F.col("payload")))
             .withColumn("title", F.when(F.col("payload").rlike(TITLE), let(F.regexp_extract("payload", TITLE, 1), lambda t: _tidy(_decoded(t)))))
             .withColumn("visible", F.regexp_replace("payload", COMMENT, " ")))
    whole = F.regexp_extract_all("visible", F.lit(LINK), F.lit(0))
    links = F.transform(whole, lambda x: F.struct(
        F.concat(F.upper(F.regexp_extract(x, LINK, 1)), F.lit("@/"), F.lower(F.regexp_extract(x, LINK, 2))).alias("path"),
        F.concat(*[F.regexp_extract(x, LINK, i) for i in (3, 4, 5)]).alias("url")))
    found = found.withColumn("links", links).drop("visible")
    found = (found.withColumn("metadata", F.to_json(F.struct(
        "target_uri", F.col("response_id").alias("refers_to"), "headers", F.col("payload_digest").alias("entity_digest"),
        F.octet_length("payload").cast("long").alias("entity_length"), "title", "links")))
        .withColumn("metadata_id", record_id("metadata", F.col("response_id"))).withColumn("conversion_id", record_id("conversion", F.col("response_id"))))
    return found.select(
        column(key), "response_id", "target_uri", "date", "payload_digest", "block_digest",
        "metadata_id", F.col("response_id").alias("metadata_refers_to"), "metadata", digest(F.col("metadata")).alias("metadata_digest"), F.octet_length("metadata").cast("long").alias("metadata_length"),
        "conversion_id", F.col("response_id").alias("conversion_refers_to"), "text", digest(F.col("text")).alias("text_digest"), F.octet_length("text").cast("long").alias("text_length"),
        F.size("links").cast("long").alias("n_links"))


def records(derived: DataFrame) -> DataFrame:
    """``(record_id, record)``: two WARC 1.0 records per row of :func:`derive`, header and block, without the closing breaks."""

    def one(kind: str, body: str, own_digest: str, length: str, type_: str) -> Column:
        lines = [F.lit("WARC/1.0"), F.lit(f"WARC-Type: {kind}"), F.when(F.col("target_uri").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), "target_uri")),
                 F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Record-ID: "), f"{kind}_id"), F.concat(F.lit("WARC-Refers-To: "), f"{kind}_refers_to"),
                 F.concat(F.lit("WARC-Block-Digest: "), own_digest), F.concat(F.lit("WARC-Source-Payload-Digest: "), "payload_digest"), F.lit(f"Content-Type: {type_}"),
                 F.concat(F.lit("Content-Length: "), F.col(length).cast("string"))]
        return F.struct(F.col(f"{kind}_id").alias("record_id"), F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), F.col(body)).alias("record"))

    both = F.array(one("metadata", "metadata", "metadata_digest", "metadata_length", "application/json"), one("conversion", "text", "text_digest", "text_length", "text/plain"))
    return derived.select(F.inline(both))


def write(derived: DataFrame, folder: str, compression: str = "gzip") -> None:
    """The records as WARC files, one per task, each record closed by two line breaks; written by Spark's own text sink."""
    records(derived).select("record").write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", compression).text(folder)
