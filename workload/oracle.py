"""SQL (DuckDB) for the queries of the same names, written independently over the same tables."""

from __future__ import annotations

import re

# ---------------------------------------------------------------- shared relations

_CTES: dict[str, str] = {}


def _cte(name: str, body: str) -> None:
    _CTES[name] = body.strip()


def _sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the shared relations it needs in front."""
    known = {**_CTES, **(extra or {})}
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need_before = known[name]
                wanted.append(name)
                need(need_before)

    need(body)
    ordered = [n for n in known if n in wanted]
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in ordered) + "\n" + body


_cte("cat", r"""
    SELECT *, folder || '/' || name AS path, upper(name) AS name_key, mtime_us // 1000000 AS saved_s
    FROM (
        SELECT doc_id, root, 0 AS attributes, strlen(text) AS size_bytes,
               CASE WHEN root = 'archive' THEN '/archive/' || lang || '/b' || (doc_id // 200)
                    ELSE '/' || root || '/' || lang || '/' || source || '/b' || (doc_id // 200) END AS folder,
               CASE WHEN root = 'backup' AND doc_id % 3 = 0 THEN 'D' || (doc_id % 200) || '.TXT'
                    ELSE 'd' || (doc_id % 200) || '.txt' END AS name,
               1704067200000000 + (doc_id % 60) * 1000000 + CASE WHEN root = 'backup' THEN 400000 ELSE 0 END
                 + CASE WHEN root = 'backup' AND noisy AND doc_id % 17 = 0 THEN 60000000 ELSE 0 END AS mtime_us,
               CASE WHEN root = 'backup' AND noisy AND doc_id % 13 = 0
                    THEN substr(text, 2) || substr(text, 1, 1) ELSE text END AS content
        FROM (SELECT *, CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 AS noisy FROM documents) d,
             (VALUES ('live'), ('backup'), ('archive')) v(root)
        WHERE root = 'live' OR (root = 'backup' AND NOT (noisy AND doc_id % 19 = 0))
           OR (root = 'archive' AND source = 'src1' AND doc_id < 200)
    ) r
""")
_cte("dirs", r"""
    SELECT DISTINCT unnest(list_transform(range(1, len(p)), lambda i: '/' || array_to_string(p[2:i+1], '/'))) AS path
    FROM (SELECT DISTINCT string_split(folder, '/') AS p FROM cat)
""")
_ANCESTORS = "unnest(list_transform(range(1, len(string_split({0}, '/'))), lambda i: '/' || array_to_string(string_split({0}, '/')[2:i+1], '/')))"
_PARENT = "regexp_replace({0}, '/[^/]*$', '')"
_BASE = "regexp_extract({0}, '[^/]*$')"
_DEPTH = "len(list_filter(string_split({0}, '/'), lambda x: x <> ''))"
_ORDER = _DEPTH + ", upper({0}), {0}"

_cte("later", r"""
    SELECT * REPLACE (mtime_us + CASE WHEN doc_id % 29 = 0 THEN 3600000000 ELSE 0 END AS mtime_us,
                      saved_s + CASE WHEN doc_id % 29 = 0 THEN 3600 ELSE 0 END AS saved_s)
    FROM cat
    WHERE root <> 'archive' AND NOT (root = 'backup' AND doc_id % 23 = 0) AND NOT (root = 'live' AND doc_id % 31 = 0)
""")
_cte("later_dirs", "SELECT path FROM dirs WHERE path <> '/archive' AND path NOT LIKE '/archive/%'")


def _duplicates(prefix: str, source: str) -> dict[str, str]:
    """Candidates, members (with copies and position) and sets of a files relation."""
    scan_order = "replace(folder, '/', chr(1)) || chr(1) || chr(1) || name"
    return {
        f"{prefix}cand": f"""
            SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name_key, saved_s, size_bytes) AS alike FROM {source})
            WHERE alike > 1""",
        f"{prefix}members": f"""
            SELECT *, row_number() OVER (PARTITION BY name_key, saved_s, size_bytes, md5
                                         ORDER BY {_ORDER.format('folder')}, path) AS pos
            FROM (SELECT *, count(*) OVER (PARTITION BY name_key, saved_s, size_bytes, md5) AS copies
                  FROM (SELECT *, upper(md5(content)) AS md5 FROM {prefix}cand)) h
            WHERE copies > 1""",
        f"{prefix}sets": f"""
            SELECT name_key, saved_s, size_bytes, md5, count(*) AS copies, arg_min(name, {scan_order}) AS file_name,
                   arg_min(mtime_us, {scan_order}) AS saved_us,
                   string_agg(folder, '|' ORDER BY pos) AS locations
            FROM {prefix}members GROUP BY ALL""",
        f"{prefix}copies": f"""
            SELECT s.file_name, s.saved_us, m.* FROM {prefix}members m
            JOIN {prefix}sets s USING (name_key, saved_s, size_bytes, md5)""",
    }


for _name, _body in _duplicates("dup_", "cat").items():
    _cte(_name, _body)


def _fingerprints(prefix: str, files: str, dirs: str, md5: str = "", tainted: str = "SELECT '' AS path") -> dict[str, str]:
    """Folder fingerprints level by level: the tree of the derived catalog is four levels deep."""
    line = f"'F|' || name_key || '|' || saved_s || '|' || size_bytes{md5}"
    found = {f"{prefix}bad": tainted}
    for level in (4, 3, 2, 1):
        below = f"{prefix}l{level + 1}"
        children = (
            ""
            if level == 4
            else f"""
            UNION ALL
            SELECT {_PARENT.format('path')}, CASE WHEN fp IS NOT NULL THEN 'D|' || upper({_BASE.format('path')}) || '|' || fp END,
                   file_count, folder_count + 1, size_bytes FROM {below}"""
        )
        found[f"{prefix}l{level}"] = f"""
            SELECT d.path,
                   CASE WHEN d.path IN (SELECT path FROM {prefix}bad) OR count(*) FILTER (WHERE x.at IS NOT NULL AND x.line IS NULL) > 0
                        THEN NULL ELSE sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.line), '')) END AS fp,
                   CAST(coalesce(sum(x.file_count), 0) AS BIGINT) AS file_count,
                   CAST(coalesce(sum(x.folder_count), 0) AS BIGINT) AS folder_count,
                   CAST(coalesce(sum(x.size_bytes), 0) AS BIGINT) AS size_bytes
            FROM (SELECT path FROM {dirs} WHERE {_DEPTH.format('path')} = {level}) d
            LEFT JOIN (SELECT folder AS at, {line} AS line, 1 AS file_count, 0 AS folder_count, size_bytes FROM {files}
                       {children}) x ON x.at = d.path
            GROUP BY d.path"""
    found[f"{prefix}prints"] = " UNION ALL ".join(f"SELECT * FROM {prefix}l{n}" for n in (4, 3, 2, 1))
    found[f"{prefix}alike"] = f"""
        SELECT * FROM (
            SELECT *, upper({_BASE.format('path')}) AS name_key,
                   count(*) OVER (PARTITION BY fp, upper({_BASE.format('path')})) AS copies,
                   min(path) OVER (PARTITION BY fp, upper({_BASE.format('path')})) AS first_equal
            FROM {prefix}prints WHERE fp IS NOT NULL AND file_count > 0)
        WHERE copies > 1"""
    return found


def _folder_sets(prefix: str, files: str, dirs: str, tainted: str = "SELECT '' AS path") -> dict[str, str]:
    """Top-most folder sets. Content decides: files are compared with their hash."""
    found = _fingerprints(prefix, files, dirs, " || '|' || md5(content)", tainted)
    found[f"{prefix}top"] = f"""
        SELECT * FROM (
            SELECT m.*, bool_or(p.path IS NULL) OVER (PARTITION BY m.first_equal) AS outside
            FROM {prefix}alike m LEFT JOIN {prefix}alike p ON p.path = {_PARENT.format('m.path')})
        WHERE outside"""
    found[f"{prefix}folder_sets"] = f"""
        SELECT first_equal, arg_min({_BASE.format('path')}, ({_ORDER.format('path')})) AS folder_name,
               any_value(file_count) AS file_count, any_value(folder_count) AS folder_count,
               any_value(size_bytes) AS size_bytes, count(*) AS copies,
               string_agg(path, '|' ORDER BY {_ORDER.format('path')}) AS locations,
               arg_min(path, ({_ORDER.format('path')})) AS first_location
        FROM {prefix}top GROUP BY first_equal"""
    found[f"{prefix}folder_copies"] = f"""
        SELECT s.folder_name, s.file_count, s.folder_count, s.size_bytes, s.copies, t.path AS folder, t.first_equal,
               row_number() OVER (PARTITION BY t.first_equal ORDER BY {_ORDER.format('t.path')}) AS pos
        FROM {prefix}top t JOIN {prefix}folder_sets s USING (first_equal)"""
    return found


for _name, _body in _fingerprints("cheap_", "cat", "dirs").items():
    _cte(_name, _body)
for _name, _body in _folder_sets("full_", "cat", "dirs").items():
    _cte(_name, _body)

_cte("marked", "SELECT path, NOT ends_with(path, '/b1') AS readable FROM dirs")
_cte("flawed", """
    SELECT * REPLACE (CASE WHEN NOT (root = 'live' AND doc_id % 37 = 0) THEN size_bytes END AS size_bytes,
                      CASE WHEN NOT (root = 'backup' AND doc_id % 41 = 0) THEN content END AS content,
                      CASE WHEN root = 'live' AND doc_id % 43 = 0 THEN 262144 ELSE 0 END AS attributes)
    FROM cat
""")
_cte("reused", """
    SELECT l.path, d.md5 FROM dup_copies d
    JOIN later l ON l.folder = d.folder AND l.name_key = d.name_key AND l.size_bytes = d.size_bytes
     AND l.saved_s = d.saved_us // 1000000
""")
_cte("states", """
    SELECT d.*, CASE WHEN d.folder LIKE '/archive/%' THEN 'Unavailable' WHEN l.path IS NULL THEN 'Missing'
                     WHEN l.size_bytes = d.size_bytes AND l.saved_s = d.saved_us // 1000000 THEN 'Present'
                     ELSE 'Changed' END AS state
    FROM dup_copies d LEFT JOIN later l ON l.folder = d.folder AND l.name_key = d.name_key
""")
_cte("later_rollup", f"""
    SELECT path, CAST(sum(files) AS BIGINT) AS file_count, CAST(sum(is_below) AS BIGINT) AS folder_count,
           CAST(sum(bytes) AS BIGINT) AS size_bytes
    FROM (SELECT {_ANCESTORS.format('folder')} AS path, 1 AS files, 0 AS is_below, size_bytes AS bytes FROM later
          UNION ALL
          SELECT a, 0, CASE WHEN a = path THEN 0 ELSE 1 END, 0 FROM (SELECT path, {_ANCESTORS.format('path')} AS a FROM later_dirs))
    GROUP BY path
""")
_cte("folder_states", """
    SELECT c.*, CASE WHEN c.folder = '/archive' OR c.folder LIKE '/archive/%' THEN 'Unavailable'
                     WHEN r.path IS NULL THEN 'Missing'
                     WHEN r.file_count = c.file_count AND r.folder_count = c.folder_count AND r.size_bytes = c.size_bytes
                     THEN 'Present' ELSE 'Changed' END AS state
    FROM full_folder_copies c LEFT JOIN later_rollup r ON r.path = c.folder
""")
_KEPT = "state IN ('Present', 'Unavailable')"
_cte("outcomes", f"""
    SELECT name_key, saved_s, size_bytes, md5, any_value(file_name) AS file_name, count(*) AS checked,
           count(*) FILTER (WHERE {_KEPT}) AS surviving, count(*) FILTER (WHERE NOT {_KEPT}) AS removed,
           count(*) FILTER (WHERE state = 'Unavailable') AS unavailable
    FROM states GROUP BY ALL
""")
_cte("folder_outcomes", f"""
    SELECT first_equal, any_value(folder_name) AS folder_name, count(*) AS checked,
           count(*) FILTER (WHERE {_KEPT}) AS surviving, count(*) FILTER (WHERE NOT {_KEPT}) AS removed,
           count(*) FILTER (WHERE state = 'Unavailable') AS unavailable
    FROM folder_states GROUP BY first_equal
""")

# Upper case one character at a time: SQL's upper would change the sharp s as well.
_UPPER = "replace(upper(replace({0}, 'ß', chr(1))), chr(1), 'ß')"
_FILE_PATTERNS = "^(D1[^/]\\.TXT|.*5\\.TXT)$"

# ---------------------------------------------------------------- one statement per query


def statements() -> dict[str, str]:
    big, cold = "CAST({0} AS BIGINT)", 262_144
    instants = """(SELECT event_id, epoch_us(ts) + (event_id % 366) * 86400000000
                   - CASE WHEN event_id % 7 = 0 THEN 2000000000000000 ELSE 0 END AS us FROM events)"""
    offset_at = "CAST(epoch(timezone('America/New_York', to_timestamp({0}))) - ({0}) AS INT)"
    q: dict[str, str] = {}

    q["catalog_files"] = "SELECT path, folder, name, size_bytes, mtime_us, attributes FROM cat"
    q["catalog_folders"] = "SELECT path, true AS readable FROM dirs"
    q["scan_tree"] = """
        SELECT path, size_bytes, mtime_us FROM cat WHERE NOT regexp_matches(path, '(?i)/b3(/|$)')
        UNION ALL SELECT path, NULL, NULL FROM dirs WHERE NOT regexp_matches(path, '(?i)/b3(/|$)')"""
    q["report_roundtrip"] = """
        SELECT file_name, saved_us + 19800000000 AS local_us, 19800 AS utc_offset_s, size_bytes, md5, copies FROM dup_sets"""
    q["report_read"] = """
        SELECT file_name, md5, pos, folder FROM dup_copies
        UNION ALL SELECT folder_name, NULL, pos, folder FROM full_folder_copies"""
    q["scan_settings"] = r"""
        SELECT DISTINCT setting, value,
            CASE WHEN setting = 'exclude_name' AND value = '' THEN 'empty pattern'
                 WHEN setting = 'exclude_name' AND (contains(value, '/') OR contains(value, '\')) THEN 'path separator in pattern'
                 WHEN setting = 'minimum_size' AND NOT regexp_matches(value, '^[0-9]+(e2)?$') THEN 'not a whole number of bytes' END AS problem
        FROM (SELECT 'exclude_name' AS setting, lang || '*' AS value FROM documents
              UNION ALL SELECT 'exclude_name', url FROM pages
              UNION ALL SELECT 'exclude_name', regexp_extract(url, '#.*$') FROM pages
              UNION ALL SELECT 'minimum_size', unnest([n_chars || '', n_chars || '.5', '-' || n_chars, n_chars || '_000', n_chars || 'e2']) FROM documents)"""
    q["locations_wide"] = """
        SELECT file_name, size_bytes, md5, max(folder) FILTER (WHERE pos = 1) AS location_1,
               max(folder) FILTER (WHERE pos = 2) AS location_2, max(folder) FILTER (WHERE pos = 3) AS location_3
        FROM dup_copies GROUP BY name_key, saved_s, size_bytes, md5, file_name"""
    q["locations_unpivot"] = """
        SELECT file_name, md5, count(*) OVER g AS copies, row_number() OVER (g ORDER BY pos) AS pos, folder
        FROM dup_copies WHERE NOT (pos = 2 AND strlen(folder) % 2 = 1)
        WINDOW g AS (PARTITION BY name_key, saved_s, size_bytes, md5)"""
    q["scan_warnings"] = _sql("""
        SELECT 'folder' AS kind, path, 'unlistable' AS reason FROM marked WHERE NOT readable
        UNION ALL SELECT 'file', path, 'size or time cannot be read' FROM named WHERE size_bytes IS NULL
        UNION ALL SELECT 'cold', NULL, count(*) || ' cold files were not checked' FROM alike WHERE attributes <> 0 HAVING count(*) > 0
        UNION ALL SELECT 'hash', path, 'content cannot be read' FROM local WHERE content IS NULL""", {
        "named": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name_key) AS n FROM flawed) WHERE n > 1",
        "alike": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name_key, saved_s, size_bytes) AS k FROM named WHERE size_bytes IS NOT NULL) WHERE k > 1",
        "local": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name_key, saved_s, size_bytes) AS l FROM alike WHERE attributes = 0) WHERE l > 1",
    })
    q["scan_job_warnings"] = q["scan_warnings"]
    q["exclude_files"] = f"SELECT path FROM cat WHERE NOT regexp_matches(name_key, '{_FILE_PATTERNS}')"
    q["exclude_folders"] = """
        SELECT 'file' AS kind, path FROM cat WHERE NOT regexp_matches(folder, '(?i)/(src1[^/]*|b3)(/|$)')
        UNION ALL SELECT 'folder', path FROM dirs WHERE NOT regexp_matches(path, '(?i)/(src1[^/]*|b3)(/|$)')"""
    q["excluded_links"] = f"""
        SELECT path FROM dirs WHERE NOT ends_with(path, '/b3') AND path NOT IN
            (SELECT {_ANCESTORS.format('path')} FROM dirs WHERE ends_with(path, '/b2'))"""
    q["minimum_size"] = "SELECT path, size_bytes FROM cat WHERE size_bytes >= 1000"
    q["exclude_paths"] = """
        SELECT path, NULL AS readable FROM cat WHERE NOT (root = 'live' AND doc_id % 50 = 0)
        UNION ALL SELECT path, path NOT IN (SELECT folder FROM cat WHERE root = 'live' AND doc_id % 50 = 0) FROM dirs"""
    q["links_tainted"] = """
        SELECT path, NOT ends_with(path, '/b2') AS readable, CASE WHEN ends_with(path, '/b2') THEN 'link' END AS reason FROM dirs"""
    q["skip_cold"] = _sql("""
        SELECT path, attributes FROM (SELECT *, count(*) OVER (PARTITION BY name_key, saved_s, size_bytes) AS left_over
                                      FROM tiers WHERE attributes <> 262144) WHERE left_over > 1""", {
        "tiers": """SELECT * REPLACE (CASE WHEN root <> 'backup' THEN 0 WHEN doc_id % 3 = 0 THEN 262144
                                           WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS attributes) FROM dup_cand"""})
    q["unreadable_files"] = "SELECT path, size_bytes IS NOT NULL AS known FROM flawed"
    q["valid_md5"] = """
        SELECT doc_id, upper(m) AS md5 FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(md5(text), 1, 31)
            WHEN doc_id % 7 = 0 THEN replace(md5(text), 'a', 'g') WHEN doc_id % 11 = 0 THEN md5(text) || '0' ELSE md5(text) END AS m
            FROM documents) WHERE regexp_full_match(m, '[0-9a-f]{32}')"""
    q["files_in_folders"] = "SELECT path, folder FROM cat WHERE NOT ends_with(folder, '/b0')"
    q["folder_children"] = _sql(f"""
        SELECT path, {_PARENT.format('path')} AS parent FROM known WHERE {_PARENT.format('path')} IN (SELECT path FROM known)""",
        {"known": "SELECT path FROM dirs WHERE path NOT LIKE '%/src1'"})
    q["folder_scope"] = """
        SELECT path FROM dirs WHERE regexp_matches(path, '/src1(/|$)') OR path = '/archive' OR starts_with(path, '/archive/')"""
    q["reuse_md5"] = "SELECT path, md5 FROM reused"
    q["hash_workload"] = _sql("SELECT path FROM now_cand WHERE path NOT IN (SELECT path FROM reused)", _duplicates("now_", "later"))
    q["lookup_copy"] = """
        SELECT d.file_name, d.folder, d.md5, l.name AS found_name, l.size_bytes AS now_size, l.mtime_us AS now_us
        FROM dup_copies d LEFT JOIN later l ON l.folder = d.folder AND l.name_key = d.name_key"""
    q["root_of_path"] = """
        SELECT path, CASE WHEN root = 'live' THEN regexp_extract(path, '^/live/[^/]+') ELSE '/' || root END AS root,
               root <> 'archive' AS reachable FROM cat"""
    q["lookup_folder"] = """
        SELECT c.folder, c.folder_name, c.file_count, c.folder_count, c.size_bytes, r.file_count AS now_file_count,
               r.folder_count AS now_folder_count, r.size_bytes AS now_size_bytes
        FROM full_folder_copies c LEFT JOIN later_rollup r ON r.path = c.folder"""
    q["name_groups"] = """
        SELECT path, name_key FROM (SELECT *, count(*) OVER (PARTITION BY name_key) AS n FROM cat) WHERE n > 1"""
    q["date_size_groups"] = "SELECT path, name_key, saved_s, size_bytes FROM dup_cand"
    q["start_hash_split"] = _sql("""
        SELECT path, NULL AS start_md5 FROM grouped WHERE passes
        UNION ALL
        SELECT path, start_md5 FROM (SELECT *, count(*) OVER (PARTITION BY name_key, saved_s, size_bytes, start_md5) AS n
            FROM (SELECT *, upper(md5(encode(content)[1:256])) AS start_md5 FROM grouped WHERE NOT passes)) WHERE n > 1""", {
        "grouped": """SELECT *, size_bytes < 4096 OR bool_or(root = 'live' AND doc_id % 4 = 0)
                      OVER (PARTITION BY name_key, saved_s, size_bytes) AS passes FROM dup_cand"""})
    q["md5_groups"] = "SELECT path, md5 FROM dup_members"
    q["hash_files"] = _sql("""
        SELECT c.path, coalesce(r.md5, upper(md5(c.content))) AS md5 FROM now_cand c LEFT JOIN reused r USING (path)""",
        _duplicates("now_", "later"))
    q["duplicate_files"] = """
        SELECT file_name, saved_us + 19800000000 AS local_us, 19800 AS utc_offset_s, size_bytes, md5, pos, folder FROM dup_copies"""
    q["duplicate_files_objects"] = """
        SELECT file_name, saved_us AS local_us, 0 AS utc_offset_s, size_bytes, md5, pos, folder FROM dup_copies"""
    q["duplicate_copies"] = "SELECT file_name, size_bytes, md5, folder, name, path, pos FROM dup_copies"
    totals = """(SELECT count(*) AS file_sets, CAST(sum(copies) AS BIGINT) AS file_copies,
                        CAST(sum(size_bytes * (copies - 1)) AS BIGINT) AS reclaimable_bytes FROM dup_sets {0})"""
    q["scan_totals"] = f"""
        SELECT t.*, f.* FROM {totals.format('')} t,
            (SELECT count(*) AS folder_sets, CAST(sum(copies) AS BIGINT) AS folder_copies FROM full_folder_sets) f"""
    q["scan_totals_files_only"] = f"""
        SELECT t.*, NULL AS folder_sets, NULL AS folder_copies FROM {totals.format('WHERE size_bytes >= 1')} t"""
    q["folder_readable"] = """
        SELECT path, readable AND path NOT IN (SELECT folder FROM cat WHERE root = 'live' AND doc_id % 50 = 0) AS readable FROM marked"""
    q["copy_rank"] = f"""
        SELECT {_BASE.format('path')} AS name, path AS folder,
               row_number() OVER (PARTITION BY {_BASE.format('path')} ORDER BY {_ORDER.format('path')}) AS pos FROM dirs"""
    q["ordered_sets"] = """
        SELECT row_number() OVER (ORDER BY upper(file_name), saved_us, md5) AS rank, file_name, saved_us, md5 FROM dup_sets"""
    q["ordered_folders"] = """
        SELECT row_number() OVER (ORDER BY upper(folder_name), size_bytes, upper(first_location), first_location) AS rank,
               folder_name, size_bytes, first_location FROM full_folder_sets"""
    q["top_duplicates"] = """
        SELECT file_name, saved_us, md5, copies FROM dup_sets ORDER BY copies DESC, upper(file_name), saved_us, md5 LIMIT 10"""
    q["tainted_folders"] = """
        SELECT path FROM marked WHERE NOT readable
        UNION SELECT folder FROM flawed WHERE size_bytes IS NULL OR content IS NULL"""
    q["provable_folders"] = f"""
        SELECT path FROM dirs WHERE path NOT IN (SELECT {_ANCESTORS.format('path')} FROM
            (SELECT path FROM marked WHERE NOT readable UNION SELECT folder FROM flawed WHERE size_bytes IS NULL) t)"""
    q["folder_fingerprint"] = """
        SELECT path, file_count, folder_count, size_bytes, min(path) OVER (PARTITION BY fp) AS first_equal FROM cheap_prints"""
    q["folder_fingerprint_delta"] = _sql(
        "SELECT path, file_count, folder_count, size_bytes, min(path) OVER (PARTITION BY fp) AS first_equal FROM now_prints",
        _fingerprints("now_", "later", "later_dirs"))
    q["folder_rollup"] = f"""
        SELECT path, {big.format('sum(f)')} AS file_count, {big.format('sum(d)')} AS folder_count,
               {big.format('sum(b)')} AS size_bytes, true AS readable
        FROM (SELECT {_ANCESTORS.format('folder')} AS path, 1 AS f, 0 AS d, size_bytes AS b FROM cat
              UNION ALL SELECT a, 0, CASE WHEN a = path THEN 0 ELSE 1 END, 0
              FROM (SELECT path, {_ANCESTORS.format('path')} AS a FROM dirs)) GROUP BY path"""
    q["repeated_name_scope"] = _sql(f"""
        SELECT path FROM (SELECT path, {_ANCESTORS.format('path')} AS a FROM dirs) WHERE a IN (SELECT path FROM repeated)
        GROUP BY path""", {"repeated": f"""
        SELECT path FROM (SELECT path, count(*) OVER (PARTITION BY upper({_BASE.format('path')})) AS n FROM dirs) WHERE n > 1"""})
    q["folder_candidates"] = "SELECT path, name_key, file_count FROM cheap_alike"
    q["folder_sets_all"] = "SELECT path, first_equal, file_count, folder_count, size_bytes FROM full_alike"
    shown = "SELECT folder_name, file_count, folder_count, size_bytes, pos, folder FROM {0}folder_copies"
    q["duplicate_folders"] = shown.format("full_")
    q["duplicate_folders_spelt"] = q["duplicate_folders"]
    q["duplicate_folders_excl"] = _sql(shown.format("kept_"), {
        "kept_files": f"""SELECT * FROM cat WHERE NOT regexp_matches(folder, '(?i)/(b3|d1[^/]\\.txt|[^/]*5\\.txt)(/|$)')
                          AND NOT regexp_matches(name_key, '{_FILE_PATTERNS}')""",
        "kept_dirs": "SELECT path FROM dirs WHERE NOT ends_with(path, '/b3')",
        **_folder_sets("kept_", "kept_files", "kept_dirs")})
    q["duplicate_folders_cold"] = _sql(shown.format("warm_"), _folder_sets(
        "warm_", "cat", "dirs", "SELECT folder AS path FROM cat WHERE root = 'live' AND doc_id % 13 = 5"))

    q["fn_name_key"] = f"SELECT doc_id, {_UPPER.format('nfc_normalize(text)')} AS name_key FROM documents"
    q["fn_upper_simple"] = f"SELECT conv_id, turn, {_UPPER.format('text')} AS upper_text FROM conversations"
    q["fn_sort_key"] = r"""
        SELECT page_id, regexp_replace(hex(url), '(..)', '00\1', 'g') AS exact,
               regexp_replace(hex(upper(url)), '(..)', '00\1', 'g') AS folded FROM pages"""
    q["fn_path_depth"] = r"""
        SELECT page_id, len(list_filter(regexp_split_to_array(url, '[/\\]'), lambda x: x <> '')) AS depth FROM pages"""
    q["fn_path_parts"] = f"""
        SELECT path, name AS base, folder AS parent, {_PARENT.format('folder')} AS above, path AS joined FROM cat"""
    q["fn_ancestors"] = """
        SELECT page_id, i - 1 AS level, scheme || array_to_string(parts[1:i], '/') AS ancestor
        FROM (SELECT page_id, scheme, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://') AS scheme,
                    list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS parts FROM pages))"""
    q["fn_wildcard_regex"] = """
        SELECT p_partkey, p_name ILIKE '%l%_e%' AS runs, p_name ILIKE '_L%' AS anchored, p_name ILIKE 'small ring' AS exact,
               p_name ILIKE 'b%t' AS ends, p_name ILIKE '%a%a%e%n%' AS many FROM part"""
    q["fn_saved_second"] = f"SELECT event_id, CAST(floor(us / 1000000.0) AS BIGINT) AS second FROM {instants}"
    whole = "CAST(floor({0} / 1000000.0) AS BIGINT)"
    q["fn_utc_offset"] = f"""
        SELECT event_id, {offset_at.format(whole.format('us'))} AS offset_s FROM {instants}"""
    # Eastern time in 2024: summer time from 10 March 2:00 (the skipped hour counts as standard time) to
    # 3 November; the repeated hour from 1:00 counts as standard time.
    q["fn_local_utc_offset"] = """
        SELECT event_id, CASE WHEN wall >= epoch(TIMESTAMP '2024-03-10 03:00:00') AND wall < epoch(TIMESTAMP '2024-11-03 01:00:00')
                              THEN -14400 ELSE -18000 END AS offset_s
        FROM (SELECT event_id, 1704067200 + (event_id % 35136) * 900 AS wall FROM events)"""
    q["fn_offset_text"] = """
        SELECT event_id, CASE WHEN s < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(s) // 3600, abs(s) // 60 % 60)
               || CASE WHEN abs(s) % 60 <> 0 THEN printf(':%02d', abs(s) % 60) ELSE '' END AS offset_text, s AS parsed_s
        FROM (SELECT event_id, CAST((event_id * 37) % 100000 - 50000 AS INT) AS s FROM events)"""
    q["fn_same_saved_date"] = f"""
        SELECT event_id, {whole.format('us')} =
            {whole.format('(us + CASE event_id % 3 WHEN 0 THEN 400000 WHEN 1 THEN -400000 ELSE 1000000 END)')} AS same
        FROM {instants}"""
    q["fn_parse_size"] = """
        SELECT doc_id, n_chars || half || unit AS size_text,
               CASE WHEN doc_id % 8 < 6 AND v < 9223372036854775808.0 THEN CAST(v AS BIGINT) END AS size_bytes
        FROM (SELECT *, round_even(CAST(n_chars || half AS DOUBLE) * CASE WHEN doc_id % 8 < 6 THEN pow(1024, doc_id % 8) ELSE 1 END, 0) AS v
              FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN '.5' ELSE '' END AS half,
                           ['', 'kb', 'MB', 'Gb', 'TB', 'PB', 'B', ' KB'][doc_id % 8 + 1] AS unit FROM documents))"""
    q["fn_md5"] = """
        SELECT doc_id, upper(md5(text)) AS full_md5, upper(md5(encode(text)[1:256])) AS start_md5 FROM documents"""

    q["copy_states"] = "SELECT file_name, folder, md5, state FROM states"
    q["folder_copy_states"] = "SELECT folder_name, folder, state FROM folder_states"
    q["removed_copies"] = """
        SELECT folder || '/' || file_name AS path, state, state <> 'Unavailable' AS removed FROM states WHERE state <> 'Present'
        UNION ALL SELECT folder, state, state <> 'Unavailable' FROM folder_states WHERE state <> 'Present'"""
    q["validate_rows"] = "SELECT file_name, size_bytes, md5, surviving AS copies FROM outcomes WHERE surviving >= 2"
    q["validate_copies"] = f"""
        SELECT file_name, md5, row_number() OVER (PARTITION BY name_key, saved_s, size_bytes, md5 ORDER BY pos) AS pos, folder
        FROM states SEMI JOIN (SELECT * FROM outcomes WHERE surviving >= 2) o USING (name_key, saved_s, size_bytes, md5) WHERE {_KEPT}
        UNION ALL
        SELECT folder_name, NULL, row_number() OVER (PARTITION BY first_equal ORDER BY pos), folder
        FROM folder_states SEMI JOIN (SELECT * FROM folder_outcomes WHERE surviving >= 2) o USING (first_equal) WHERE {_KEPT}"""
    counters = """count(*) AS {0}rows_checked, {1} AS {0}copies_checked, {2} AS {0}copies_removed, {3} AS {0}copies_unavailable,
        count(*) FILTER (WHERE surviving < 2) AS {0}rows_removed, count(*) FILTER (WHERE surviving >= 2) AS {0}rows_remaining"""
    summed = [f"CAST(coalesce(sum({c}), 0) AS BIGINT)" for c in ("checked", "removed", "unavailable")]
    lost = "bool_or(removed > 0 OR surviving < 2)"
    q["validate_summary"] = f"""
        SELECT a.* EXCLUDE (c), b.* EXCLUDE (c), a.c OR b.c AS changed
        FROM (SELECT {counters.format('', *summed)}, {lost} AS c FROM outcomes) a,
             (SELECT {counters.format('folder_', *summed)}, {lost} AS c FROM folder_outcomes) b"""
    edited = _duplicates("again_", "edited")
    edited["again_members"] = edited["again_members"].replace("upper(md5(content))", "md5_now")
    q["incremental_rescan"] = _sql(
        "SELECT file_name, saved_us, 0 AS utc_offset_s, size_bytes, md5, copies FROM again_sets", {
            "edited": """SELECT l.*, coalesce(r.md5, upper(md5(CASE WHEN l.doc_id % 6 = 0 THEN reverse(l.content) ELSE l.content END))) AS md5_now
                         FROM later l LEFT JOIN reused r USING (path)""", **edited})
    q["rescan_stream"] = "SELECT file_name, saved_us AS local_us, 0 AS utc_offset_s, size_bytes, md5, copies FROM dup_sets"
    left = {"left_files": "SELECT * FROM cat WHERE NOT (root = 'live' AND doc_id % 5 = 0)", **_duplicates("left_", "left_files")}
    q["rescan_stream_deletions"] = _sql("SELECT file_name, saved_us AS local_us, 0 AS utc_offset_s, size_bytes, md5, copies FROM left_sets", left)
    return {name: text if text.startswith("WITH ") else _sql(text) for name, text in q.items()}
