"""SQL building blocks of the checks: the derived views once more, for another engine."""

from __future__ import annotations

EXT = ("CASE doc_id % 8 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'log' WHEN 3 THEN 'csv' WHEN 4 THEN 'json' "
       "WHEN 5 THEN 'py' WHEN 6 THEN 'zip' ELSE 'jpg' END")

CTES = {
    "doc_files": f"""
        SELECT doc_id, dir || '/' || name AS path, dir, name, ext, size, mtime FROM (
          SELECT doc_id, '/lake/docs/' || source || '/' || lang AS dir,
            translate(split_part(text,' ',1) || '_' || split_part(text,' ',2), chr(10) || '/', '__')
              || '_' || CAST(doc_id AS VARCHAR) || '.' || {EXT} AS name,
            {EXT} AS ext, n_chars AS size, 1704067200 + (doc_id * 7919) % 31536000 AS mtime
          FROM documents)""",
    "page_files": """
        SELECT dir || '/' || name AS path, dir, name, ext, size, mtime FROM (
          SELECT '/lake/web/' || split_part(url,'/',3) AS dir, 'page_' || CAST(page_id AS VARCHAR) || '.html' AS name,
            'html' AS ext, CAST(length(html) AS BIGINT) AS size,
            1704067200 + (page_id * 104729) % 31536000 AS mtime FROM pages)""",
    "files": """
        SELECT *, CASE ext WHEN 'zip' THEN 'archive' WHEN 'json' THEN 'application' WHEN 'jpg' THEN 'image'
                  ELSE 'text' END AS mimeclass
        FROM (SELECT path, dir, name, ext, size, mtime FROM doc_files
              UNION ALL SELECT path, dir, name, ext, size, mtime FROM page_files)""",
    "file_meta": """
        SELECT f.path, m.key, m.value, m.num FROM (
          SELECT doc_id, 'doc.lang' AS key, lang AS value, CAST(NULL AS DOUBLE) AS num FROM documents
          UNION ALL SELECT doc_id, 'doc.quality', CAST(quality AS VARCHAR), CAST(quality AS DOUBLE) FROM labels
          UNION ALL SELECT doc_id, 'doc.toxic', CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END, NULL FROM labels
          UNION ALL SELECT DISTINCT conv_id, 'doc.speaker', role, CAST(NULL AS DOUBLE) FROM conversations) m
        JOIN doc_files f USING (doc_id)""",
    "content": r"""
        SELECT f.path, regexp_replace(d.text, '[\x00\x02\x03]', '', 'g') AS body
        FROM documents d JOIN doc_files f USING (doc_id)
        WHERE f.ext IN ('txt', 'md', 'log', 'csv', 'json', 'py')""",
    "old_files": """
        SELECT path, dir, name, f.ext, size, mtime, CASE ext WHEN 'zip' THEN 'archive' WHEN 'json' THEN 'application'
            WHEN 'jpg' THEN 'image' ELSE 'text' END AS mimeclass,
          ext IN ('txt', 'md', 'log', 'csv', 'json', 'py') AS content_indexed,
          doc_id IN (SELECT doc_id FROM labels) AS meta_extracted, CAST(1 AS BIGINT) AS gen FROM doc_files f""",
    "new_scan": """
        SELECT path, dir, name, ext, size, mtime + coalesce(quality, 0) AS mtime FROM doc_files LEFT JOIN labels USING (doc_id)
        WHERE coalesce(toxic, 0) = 0 UNION ALL SELECT path, dir, name, ext, size, mtime FROM page_files""",
    "applied": """
        SELECT coalesce(n.path, o.path) AS path, coalesce(n.size, o.size) AS size, coalesce(n.mtime, o.mtime) AS mtime,
          coalesce(n.ext, o.ext) AS ext,
          CASE coalesce(n.ext, o.ext) WHEN 'zip' THEN 'archive' WHEN 'json' THEN 'application' WHEN 'jpg' THEN 'image' ELSE 'text' END AS mimeclass,
          CASE WHEN n.path IS NULL THEN o.content_indexed ELSE coalesce(o.content_indexed AND o.size = n.size AND o.mtime = n.mtime, false) END AS content_indexed,
          CASE WHEN n.path IS NULL THEN o.meta_extracted ELSE coalesce(o.meta_extracted AND o.size = n.size AND o.mtime = n.mtime, false) END AS meta_extracted,
          CAST(CASE WHEN n.path IS NULL THEN 1 ELSE 2 END AS BIGINT) AS gen
        FROM old_files o FULL OUTER JOIN new_scan n ON o.path = n.path""",
}
NEEDS = {
    "old_files": ("doc_files",), "new_scan": ("doc_files", "page_files"), "applied": ("old_files", "new_scan"),
    "files": ("doc_files", "page_files"), "file_meta": ("doc_files",), "content": ("doc_files",),
}


def with_views(*names: str, **extra: str) -> str:
    """``WITH`` clause holding the named views, what they build on, and further ones given as keywords."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS MATERIALIZED ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
