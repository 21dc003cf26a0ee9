"""SQL fragments (DuckDB dialect) for the oracle side of each query.

They restate the operators' semantics in plain SQL, independently of the
Spark column expressions, so the driver can compare both.
"""

from __future__ import annotations

from cashweave.schema import KEYWORD_LEXICON


def canon_amount(a: str) -> str:
    return (f"regexp_replace(regexp_replace(CAST({a} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), "
            f"'\\.$', '')")


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def canon_desc(s: str) -> str:
    return f"regexp_replace(lower({strip(s)}), '\\s+', ' ', 'g')"


def content_hash(d: str, a: str, s: str) -> str:
    return (f"sha256(strftime({d}, '%Y-%m-%d') || '|' || {canon_amount(a)} || '|' || "
            f"{canon_desc(s)})")


def money(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)))"


def coerce_amount(raw: str) -> str:
    s = strip(raw)
    body = (f"regexp_replace(CASE WHEN {s} LIKE '(%' AND {s} LIKE '%)' "
            f"THEN substr({s}, 2, length({s}) - 2) ELSE {s} END, '[$€£, ]', '', 'g')")
    val = (f"CASE WHEN regexp_full_match({body}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
           f"THEN TRY_CAST({body} AS DECIMAL(38,10)) END")
    return (f"CASE WHEN {raw} IS NULL OR {s} = '' OR lower({s}) IN ('nan', 'none', 'null') THEN NULL "
            f"WHEN {s} LIKE '(%' AND {s} LIKE '%)' THEN -({val}) ELSE {val} END")


def lexicon_values() -> str:
    rows = ", ".join(
        f"({i}, '{k.replace(chr(39), chr(39) * 2)}', '{c.replace(chr(39), chr(39) * 2)}')"
        for i, (k, c) in enumerate(KEYWORD_LEXICON))
    return f"(VALUES {rows}) AS x(ord, keyword, category)"


def categorize_cte(src: str, key: str = "row_ord") -> str:
    """CTE body producing (key, category, confidence, rationale) for ``src``
    (which needs key, description, amount)."""
    return f"""
    hits AS (
      SELECT t.{key} AS k, x.category, SUM(length(x.keyword)) AS score, MIN(x.ord) AS first_pos
      FROM {src} t JOIN {lexicon_values()} ON contains(lower(t.description), x.keyword)
      GROUP BY 1, 2),
    ranked AS (
      SELECT k, category, score, SUM(score) OVER (PARTITION BY k) AS total,
             row_number() OVER (PARTITION BY k ORDER BY score DESC, first_pos) AS rn
      FROM hits),
    cat AS (
      SELECT t.{key} AS k,
             CASE WHEN r.k IS NOT NULL THEN r.category
                  WHEN t.amount > 0 THEN 'Income' ELSE 'Uncategorized' END AS category,
             CASE WHEN r.k IS NOT NULL THEN
                    round(least(0.99, CAST(0.55 AS DOUBLE) + (CAST(r.score AS DOUBLE) / CAST(r.total AS DOUBLE)) * CAST(0.4 AS DOUBLE)), 3)
                  WHEN t.amount > 0 THEN 0.55 ELSE 0.30 END AS confidence,
             CASE WHEN r.k IS NOT NULL THEN 'matched keywords -> ' || r.category
                  WHEN t.amount > 0 THEN 'positive amount, no keyword match'
                  ELSE 'no keyword matched' END AS rationale
      FROM {src} t LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON r.k = t.{key})
    """


def pii_mask(x: str) -> str:
    """The masking chain in RE2. RE2 has no look-around, so each Python
    ``\\b`` is matched as a captured neighbour character and put back; the
    boundary patterns run twice so matches separated by one character are
    all found."""
    w, nw, d = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]", r"\p{Nd}"

    def rr(s: str, pat: str, rep: str) -> str:
        return f"regexp_replace({s}, '{pat}', '{rep}', 'g')"

    s = f"coalesce({x}, '')"
    s = rr(s, r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "[EMAIL]")
    for _ in range(2):
        s = rr(s, rf"(^|{nw})({d}{{3}}-{d}{{2}}-{d}{{4}})($|{nw})", r"\1[SSN]\3")
    for _ in range(2):
        s = rr(s, rf"(^|{nw})((?:{d}[ -]?){{12,18}}{d})(?:([ -])({w})|($|{nw}))", r"\1[CARD]\4\5")
    s = rr(s, rf"(?:(?:\+?{d}{{1,3}}[ .-]?)?\(?{d}{{3}}\)?[ .-]?{d}{{3}}[ .-]?{d}{{4}})", "[PHONE]")
    for _ in range(2):
        s = rr(s, rf"(^|{nw})({d}{{8,}})($|{nw})", r"\1[ACCT]\3")
    return s


def token_counts(src: str, key: str, text: str, dim: int = 256) -> str:
    """(k, bucket, cnt) hashing-embedder counts of ``text`` per ``key``."""
    return f"""
    SELECT k, CAST(('0x' || substr(md5(lower(tok)), 1, 8)) AS BIGINT) % {dim} AS bucket, count(*) AS cnt
    FROM (SELECT {key} AS k, unnest(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_]+')) AS tok FROM {src}) t
    GROUP BY 1, 2"""


def intent(q: str) -> str:
    from cashweave.schema import GENERAL_INTENT, INTENT_PATTERNS
    whens = " ".join(f"WHEN regexp_matches({q}, '{p}') THEN '{name}'" for name, p in INTENT_PATTERNS)
    return f"CASE {whens} ELSE '{GENERAL_INTENT}' END"


def question_amount(q: str) -> str:
    from cashweave.schema import QUESTION_AMOUNT_PATTERN
    return (f"CAST(replace(nullif(regexp_extract({q}, '{QUESTION_AMOUNT_PATTERN}', 1), ''), ',', '') "
            f"AS DOUBLE)")


def question_category(q: str) -> str:
    from cashweave.schema import CATEGORY_SYNONYMS, TAX_CATEGORIES
    pairs = [(c.lower(), c) for c in TAX_CATEGORIES] + list(CATEGORY_SYNONYMS)
    whens = " ".join(f"WHEN contains(lower({q}), '{w}') THEN '{c}'" for w, c in pairs)
    return f"CASE {whens} END"
