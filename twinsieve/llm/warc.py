"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives one ``metadata`` and one ``conversion`` record. Both refer to the response and keep its target
URI and date; the metadata block carries the response's HTTP headers, its digests, title and links, and names
the conversion with its digest. Everything is an expression over one row: no shuffle, nothing gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewriting import literal, rewritten, rewritten_sql
from .syncmers import let

CRLF = "\r\n"
# HTML elements that begin a new line, and named characters.
BLOCKS = (
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul"
).split()
NAMED = {
    "nbsp": " ", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€",
    "pound": "£", "cent": "¢", "yen": "¥", "sect": "§", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è",
    "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
    "lt": "<", "gt": ">",
}
_NAMES = [("replace", f"&{name};", char) for name, char in NAMED.items()] + [("replace", "&amp;", "&")]
TITLE = r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"
HREF = r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""
NUMBER = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
PLAIN = [
    ("regex", r"(?s)<!--.*?(?:-->|\z)", ""),
    *[("regex", rf"(?is)<{name}\b.*?(?:</{name}\s*>|\z)", "") for name in ("script", "style", "title")],
    ("regex", "[ \t\r\n\f]+", " "),
    ("regex", rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*(?:>|\z)", "\n"),
    ("regex", r"(?i)<[/!?]?[a-z][^>]*(?:>|\z)", ""),
]
LAYOUT = [("regex", "[ \t\r\f]+", " "), ("regex", r" *\n[ \n]*", "\n"), ("regex", r"^[ \n]+|[ \n]+$", "")]
INLINE = [("regex", r"\s+", " "), ("regex", "^ | $", "")]


def _numbers(text: Column) -> Column:
    """Numeric character references as characters; numbers of no character become U+FFFD."""

    def char(ref: Column) -> Column:
        is_hex = F.lower(F.substring(ref, 1, 1)) == "x"
        code = F.when(is_hex, F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("bigint")
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")

    def replaced(t: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(t, F.lit(NUMBER), 1))
        return F.when(
            F.contains(t, F.lit("&#")), F.aggregate(refs, t, lambda x, ref: F.replace(x, F.concat(F.lit("&#"), ref, F.lit(";")), char(ref)))
        ).otherwise(t)

    return let(text, replaced)


def _names(text: Column) -> Column:
    """Named character references as characters: cut at every ``&``, and the name behind it looked up."""
    known = F.create_map(*[F.lit(x) for pair in (*NAMED.items(), ("amp", "&")) for x in pair])

    def resolved(part: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        char = F.when(F.contains(part, F.lit(";")), F.try_element_at(known, name))
        return F.coalesce(F.concat(char, F.substr(part, F.char_length(name) + 2)), F.concat(F.lit("&"), part))

    def replaced(t: Column) -> Column:
        return let(F.split(t, "&"), lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), resolved), "")))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), replaced(t)).otherwise(t))


def plain_text(html: Column) -> Column:
    """Visible text: one line per block, white space collapsed, character references resolved."""
    return rewritten(_names(_numbers(rewritten(html, PLAIN))), LAYOUT)


def urn(*parts: Column) -> Column:
    """A name-based URN: version 3 of the parts joined by ``|``."""
    def cut(h: Column) -> Column:
        shown = [F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)]
        return F.concat(F.lit("<urn:uuid:"), *shown, F.lit(">"))

    return let(F.md5(F.concat_ws("|", *parts).cast("binary")), cut)


def sha256(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses_of_pages(pages: DataFrame, date: str) -> DataFrame:
    """Responses of (page_id, url, html): record_id, target_uri, warc_date, http_header, payload, and page_id.

    A null html is an empty payload; a null url is kept as null.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    header = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF)
    )
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        urn(F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("warc_date"), header.alias("http_header"), payload.alias("payload"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line ends in a value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def derive(responses: DataFrame, key: str) -> DataFrame:
    """The two derived records of each response, with ``key`` to tell where they come from.

    Columns: key, record_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest,
    payload_digest (the response's), record (the whole record as it stands in a file). Every row of ``responses``
    gives two rows, repeated ones too; null headers or payloads count as empty; a null target_uri has no
    line. An empty table gives an empty one; other columns are not looked at.
    """
    empty = F.lit("")
    source = responses.select(
        key, "record_id", "target_uri", "warc_date", F.coalesce("http_header", empty).alias("http_header"), F.coalesce("payload", empty).alias("payload")
    )
    text = source.select(
        "*", plain_text(F.col("payload")).alias("text"), sha256(F.col("payload")).alias("payload_digest"),
        sha256(F.concat("http_header", F.lit(CRLF), "payload")).alias("source_digest"),
    )
    parts = text.select(
        "*", urn(F.lit("conversion"), F.col("record_id")).alias("conversion_id"), sha256(F.col("text")).alias("text_digest"),
        F.regexp_extract_all("payload", F.lit(HREF), 1).alias("links"),
        rewritten(_names(_numbers(F.regexp_extract("payload", TITLE, 1))), INLINE).alias("title"),
    )
    http = F.regexp_replace(F.regexp_replace("http_header", "(?:\r?\n)+$", ""), "\r?\n", f"{CRLF}http-header: ")
    fields = F.concat(
        _line("title", F.col("title")),
        F.lit("http-header: "), http, F.lit(CRLF),
        _line("source-payload-digest", F.col("payload_digest")), _line("source-block-digest", F.col("source_digest")),
        _line("conversion-id", F.col("conversion_id")), _line("conversion-digest", F.col("text_digest")),
        _line("conversion-length", F.octet_length("text").cast("string")), _line("outlinks", F.size("links").cast("string")),
        F.array_join(F.transform("links", lambda x: _line("outlink", x)), ""),
    )

    def record(kind: str, own: Column, media: str, block: Column, block_digest: Column) -> Column:
        length = F.octet_length(block).cast("bigint")
        head = F.concat(
            F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"), _line("WARC-Record-ID", own), _line("WARC-Refers-To", F.col("record_id")),
            _line("WARC-Refers-To-Target-URI", F.col("target_uri")), _line("WARC-Refers-To-Date", F.col("warc_date")),
            _line("WARC-Target-URI", F.col("target_uri")), _line("WARC-Date", F.col("warc_date")),
            _line("WARC-Block-Digest", block_digest), F.lit(f"Content-Type: {media}{CRLF}"), _line("Content-Length", length.cast("string")),
        )
        return F.struct(
            F.lit(kind).alias("record_type"), own.alias("own_id"), F.lit(media).alias("content_type"), length.alias("content_length"),
            block_digest.alias("block_digest"), F.concat(head, F.lit(CRLF), block, F.lit(CRLF * 2)).alias("record"),
        )

    blocks = parts.withColumn("fields", fields)
    both = F.array(
        record("metadata", urn(F.lit("metadata"), F.col("record_id")), "application/warc-fields", F.col("fields"), sha256(F.col("fields"))),
        record("conversion", F.col("conversion_id"), "text/plain; charset=utf-8", F.col("text"), F.col("text_digest")),
    )
    rows = blocks.select(key, F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "payload_digest", F.explode(both).alias("r"))
    return rows.select(
        key, "r.record_type", F.col("r.own_id").alias("record_id"), "refers_to", "target_uri", "warc_date", "r.content_type", "r.content_length",
        "r.block_digest", "payload_digest", "r.record",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """The records as WARC files in a new folder, one per partition; reruns of a lost task replace its file."""
    ended = F.regexp_replace("record", f"{CRLF * 2}\\z", "").alias("value")
    records.select(ended).write.option("lineSep", CRLF * 2).mode("error").text(path)


def page_derivatives(pages: DataFrame, date: str) -> DataFrame:
    """``derive`` for pages, with the record's SHA-256 in place of its text."""
    found = derive(responses_of_pages(pages, date), "page_id")
    return found.withColumn("record_sha256", F.sha2(F.col("record").cast("binary"), 256)).drop("record")


def page_derivatives_sql(date: str) -> str:
    def numbers(text: str) -> str:
        code = "CASE WHEN lower(r[1]) = 'x' THEN ('0' || lower(r))::BIGINT ELSE r::BIGINT END"
        char = f"CASE WHEN ({code}) > 0 AND ({code}) <= 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343 THEN chr(({code})::INT) ELSE '�' END"
        refs = f"list_transform(list_distinct(regexp_extract_all({text}, {literal(NUMBER)}, 1)), lambda r: ['&#' || r || ';', {char}])"
        return f"list_reduce(list_prepend(['', {text}], {refs}), lambda a, b: ['', replace(a[2], b[1], b[2])])[2]"

    def named(kind: str, parts: str) -> str:
        h = f"md5('{kind}|' || {parts})"
        return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-3' || {h}[14:16] || '-8' || {h}[18:20] || '-' || {h}[21:32] || '>'"

    def line(name: str, value: str) -> str:
        return f"coalesce('{name}: ' || regexp_replace({value}, '[\r\n]+', ' ', 'g') || '{CRLF}', '')"

    sha = lambda x: f"'sha256:' || sha256({x})"

    def head(kind: str, own: str, media: str, block: str, digest: str) -> str:
        lines = [
            line("WARC-Record-ID", own), line("WARC-Refers-To", "record_id"), line("WARC-Refers-To-Target-URI", "url"), line("WARC-Refers-To-Date", literal(date)),
            line("WARC-Target-URI", "url"), line("WARC-Date", literal(date)), line("WARC-Block-Digest", digest), f"'Content-Type: {media}{CRLF}'",
            line("Content-Length", f"strlen({block})::VARCHAR"),
        ]
        return f"sha256('WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}' || {' || '.join(lines)} || '{CRLF}' || {block} || '{CRLF}{CRLF}')"

    def row(kind: str, own: str, media: str, block: str, digest: str) -> str:
        return f"""SELECT page_id, '{kind}' AS record_type, {own} AS record_id, record_id AS refers_to, url AS target_uri, {literal(date)} AS warc_date,
            '{media}' AS content_type, strlen({block})::BIGINT AS content_length, {digest} AS block_digest, payload_digest,
            {head(kind, own, media, block, digest)} AS record_sha256 FROM f"""

    fields = " || ".join([
        line("title", "title"), f"'http-header: ' || replace(rtrim(http, '{CRLF}'), '{CRLF}', '{CRLF}http-header: ') || '{CRLF}'",
        line("source-payload-digest", "payload_digest"), line("source-block-digest", "source_digest"), line("conversion-id", "conversion_id"),
        line("conversion-digest", "text_digest"), line("conversion-length", "strlen(text)::VARCHAR"), line("outlinks", "len(links)::VARCHAR"),
        f"coalesce(array_to_string(list_transform(links, lambda x: {line('outlink', 'x')}), ''), '')",
    ])
    title = rewritten_sql(rewritten_sql("t2", _NAMES), INLINE)
    return f"""
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, {named('response', "page_id || '|' || coalesce(url, '')")} AS record_id,
                'HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ' || strlen(coalesce(html, '')) || '{CRLF}' AS http FROM pages
        ),
        s AS (SELECT *, {rewritten_sql('html', PLAIN)} AS t1, regexp_extract(html, {literal(TITLE)}, 1) AS t0 FROM p),
        u AS (SELECT *, {numbers('t1')} AS t3, {numbers('t0')} AS t2 FROM s),
        b AS (SELECT *, {rewritten_sql(rewritten_sql('t3', _NAMES), LAYOUT)} AS text, {title} AS title, regexp_extract_all(html, {literal(HREF)}, 1) AS links FROM u),
        d AS (SELECT *, {sha('html')} AS payload_digest, {sha(f"http || '{CRLF}' || html")} AS source_digest, {sha('text')} AS text_digest,
            {named('conversion', 'record_id')} AS conversion_id FROM b),
        f AS (SELECT *, {fields} AS fields FROM d)
        {row('metadata', named('metadata', 'record_id'), 'application/warc-fields', 'fields', sha('fields'))}
        UNION ALL {row('conversion', 'conversion_id', 'text/plain; charset=utf-8', 'text', 'text_digest')}"""
