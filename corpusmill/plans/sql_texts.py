"""SQL of queries whose definitions take more than a line: folds as recursion, rules without look-around."""

from __future__ import annotations

from ..operators import retrieval, validation
from ..operators.privacy import RULES

BLANKS = r"e' \t\n\r\x0b\f'"
#: Word characters and white space as the engine counts them (Unicode), inside brackets.
WORD, SPACE = r"\pL\pM\p{Nd}\p{Pc}", r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(x: str) -> str:
    return rf"string_split_regex(trim({x}, {BLANKS}), '\s+')"


def word_count(x: str) -> str:
    return f"(CASE WHEN trim({x}, {BLANKS}) = '' THEN 0 ELSE len({words(x)}) END)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Personal data. A rule that looks behind or ahead takes the character there along and puts it back. Number shapes may touch with one such
# character between them, so marks are put beside characters that are no part of numbers, and taken out again.
MARK = "chr(1)"
PHONE = rf"(^|[^{WORD}.])(\+?\p{{Nd}}[\p{{Nd}}{SPACE}().-]{{7,}}\p{{Nd}})($|[^{WORD}.])"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
IBAN = r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}\b"
HANDLE = rf"(^|[^{WORD}/])(@[A-Za-z][{WORD}.]{{2,}}\b)"
PERSON = rf"\b(?:Dr|Prof|Mr|Mrs|Ms|Mx|Ing|Eng|Sr|Sra|Herr|Frau)\.?[ \t]+(?:[A-ZÀ-Þ][{WORD}''’-]+[ \t]+){{0,2}}[A-ZÀ-Þ][{WORD}''’-]+"



def apart(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([^{WORD}{SPACE}.()+-])', {MARK} || '\1' || {MARK}, 'g'), '([{WORD}.])\+', '\1+' || {MARK}, 'g')"


PHONE_HITS = f"SELECT doc_id, unnest(regexp_extract_all({apart('text')}, '{PHONE}', 2)) AS hit FROM documents"

_SHAPES = {"EMAIL": (EMAIL, 0), "IBAN": (IBAN, 0), "PHONE": (PHONE, 2), "HANDLE": (HANDLE, 2), "PERSON": (PERSON, 0)}


def _identifiers() -> str:
    """m0, f1, m1, ...: texts before each rule (apart for numbers), its finds, and the text with a place holder for each find. A text's own character
    that place holders begin with is followed by one that no place holder has, and put back in the end."""
    out, last = ["m0 AS (SELECT doc_id AS doc, replace(coalesce(text, ''), chr(57344), chr(57344) || chr(57346)) AS t FROM documents)"], "m0"
    for i, (label, _) in enumerate(RULES):
        pattern, group = _SHAPES[label]
        x = apart("t") if label == "PHONE" else "t"
        hold = f"chr(57344) || '{i}' || chr(57345)"
        put = {0: hold, 2: rf"'\1' || {hold}" + (r" || '\3'" if label == "PHONE" else "")}[group]
        back = f"replace({{}}, {MARK}, '')" if label == "PHONE" else "{}"
        out.append(f"f{i} AS (SELECT doc, {i} AS rule, '{label}' AS label, regexp_extract_all({x}, '{pattern}', {group}) AS h FROM {last})")
        replaced = back.format(f"regexp_replace({x}, '{pattern}', {put}, 'g')")
        out.append(f"m{i + 1} AS (SELECT doc, {replaced} AS t FROM {last})")
        last = f"m{i + 1}"
    union = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(RULES)))
    out.append(f"hits AS (SELECT doc, rule, label, pos, h[pos + 1] AS original, trim(h[pos + 1], {BLANKS}) AS value FROM (SELECT doc, rule, label, h, unnest(range(0, len(h))) AS pos FROM ({union})))")
    out.append("firsts AS (SELECT label, value, min((doc, rule, pos)) AS f FROM hits GROUP BY ALL)")
    out.append("tokens AS (SELECT label, value, '[' || label || '_' || row_number() OVER (PARTITION BY label ORDER BY f) || ']' AS token FROM firsts)")
    return ",\n".join(out)


IDENTIFIERS = _identifiers()
SCRUBBED = f"""WITH {IDENTIFIERS},
pieces AS (SELECT doc, i, p[i] AS x FROM (SELECT doc, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc, string_split(t, chr(57344)) AS p FROM m{len(RULES)}))),
ruled AS (SELECT doc, i, CASE WHEN i > 1 AND x[1] <> chr(57346) THEN CAST(x[1] AS INTEGER) END AS rule,
  CASE WHEN i = 1 THEN x WHEN x[1] = chr(57346) THEN chr(57344) || x[2:] ELSE x[3:] END AS rest FROM pieces),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc, rule ORDER BY i) - 1 AS pos FROM ruled)
SELECT p.doc AS doc_id, md5(string_agg(coalesce(token, '') || rest, '' ORDER BY i)) AS digest FROM placed p
LEFT JOIN hits h ON h.doc = p.doc AND h.rule = p.rule AND h.pos = p.pos LEFT JOIN tokens t ON t.label = h.label AND t.value = h.value GROUP BY p.doc"""
REPORT = f"""WITH {IDENTIFIERS}
SELECT DISTINCT doc, label, original, token, count(*) OVER (PARTITION BY doc) AS total FROM hits JOIN tokens USING (label, value)"""

# Sentences that fit 40 words.
SENTENCES = rf"""WITH p AS (SELECT doc_id, text, string_split(regexp_replace(trim(text, {BLANKS}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
n AS (SELECT *, list_transform(parts, lambda x: {word_count('x')}) AS ns FROM p),
k AS (SELECT *, array_to_string(parts[1:greatest(1, len(list_filter(range(1, len(ns) + 1), lambda i: list_sum(ns[1:i]) <= 40)))], ' ') AS kept FROM n),
c AS (SELECT *, {word_count('text')} AS w, {word_count('kept')} AS wk, regexp_replace(array_to_string(({words('kept')})[1:40], ' '), '[,;:-]+$', '') AS cut FROM k)
SELECT doc_id, CASE WHEN w <= 40 THEN 'none' WHEN wk <= 40 THEN 'sentence' ELSE 'hard' END AS mode,
  md5(CASE WHEN w <= 40 THEN text WHEN wk <= 40 THEN kept WHEN regexp_matches(cut, '[.?]$') THEN cut ELSE cut || '.' END) AS digest FROM c"""


def _alone(x: str, term: str) -> str:
    shape = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in term.lower()).replace("'", "''")
    return rf"regexp_matches(lower({x}), '(^|[^{WORD}-]){shape}($|[^{WORD}-])')"


def summary_errors(x: str) -> str:
    """What makes a summary unacceptable, as a list."""
    persons = r"(?:^|[^A-Za-z])(?:(I)\s+[a-z]|(me|my|we|We|us|our|Our|ours|you|You|your|Your)(?:$|[^A-Za-z]))"
    person = f"(regexp_extract({x}, '{persons}', 1) || regexp_extract({x}, '{persons}', 2))"
    n = word_count(x)
    checks = [
        f"CASE WHEN {n} > 80 THEN {n} || ' words exceed the maximum of 80' END",
        rf"CASE WHEN regexp_matches({x}, '(?m)^\s*([-*•]|\d+[.)])\s') THEN 'summary holds a list' END",
        rf"CASE WHEN len(list_filter(string_split_regex(trim({x}, {BLANKS}), '\n\s*\n'), lambda p: trim(p, {BLANKS}) <> '')) > 1 THEN 'summary is more than one paragraph' END",
        f"CASE WHEN contains({x}, '!') THEN 'summary holds an exclamation mark' END",
        *[f"CASE WHEN {_alone(x, t)} THEN {quoted(f"non-neutral expression '{t}'")} END" for t in validation.BANNED],
        f"CASE WHEN {person} <> '' THEN 'not in the third person (''' || {person} || ''')' END",
    ]
    return f"list_filter([{', '.join(checks)}], lambda e: e IS NOT NULL)"


def summary_warnings(x: str) -> str:
    n = word_count(x)
    checks = [f"CASE WHEN {n} < 40 THEN {n} || ' words are under the usual 40' END", *[f"CASE WHEN {_alone(x, t)} THEN {quoted(f"'{t}' could be more neutral")} END" for t in validation.DISCOURAGED]]
    return f"list_filter([{', '.join(checks)}], lambda e: e IS NOT NULL)"


SUMMARY_A = f"SELECT conv_id, turn, array_to_string({summary_errors('text')}, '; ') AS errors, array_to_string({summary_warnings('text')}, '; ') AS warnings FROM conversations WHERE role = 'assistant'"

# Paragraphs of up to 2,000 characters packed with a tail of 100: one step of the recursion a piece.
PACKED = rf"""WITH RECURSIVE paragraphs AS (
  SELECT doc_id, k, q[k] AS x FROM (SELECT doc_id, q, unnest(range(1, len(q) + 1)) AS k FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\n\s*\n') AS q FROM documents)) WHERE trim(q[k], {BLANKS}) <> ''),
strips AS (SELECT doc_id, k, x, j, CAST(greatest(0, ceil((len(x) - 2000) / 1900.0)) AS BIGINT) AS n FROM (SELECT *, unnest(range(0, 1 + CAST(greatest(0, ceil((len(x) - 2000) / 1900.0)) AS BIGINT))) AS j FROM paragraphs)),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i, j < n AS alone, CASE WHEN j < n THEN substr(x, j * 1900 + 1, 2000) ELSE substr(x, j * 1900 + 1) END AS piece FROM strips),
fold(doc_id, i, held, full_, single) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM pieces
  UNION ALL
  SELECT f.doc_id, p.i, CASE WHEN alone THEN '' WHEN held = '' THEN piece WHEN len(held) + 2 + len(piece) > 2000 THEN right(held, 100) || e'\n\n' || piece ELSE held || e'\n\n' || piece END,
    CASE WHEN held <> '' AND (alone OR len(held) + 2 + len(piece) > 2000) THEN held END, CASE WHEN alone THEN piece END
  FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
chunks AS (SELECT doc_id, i, 0 AS part, full_ AS chunk FROM fold WHERE full_ IS NOT NULL UNION ALL SELECT doc_id, i, 1, single FROM fold WHERE single IS NOT NULL
  UNION ALL SELECT doc_id, max(i), 2, arg_max(held, i) FROM fold GROUP BY doc_id HAVING trim(arg_max(held, i), {BLANKS}) <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS INTEGER) AS chunk_no, md5(chunk) AS digest FROM chunks"""

# Windows of 4,000 characters that end at a blank line or a sentence in their second half, with an overlap of 100.
SOUGHT = rf"""WITH RECURSIVE fold(doc_id, text, start, stop) AS (
  SELECT doc_id, text, CAST(0 AS BIGINT), {{first}} FROM (SELECT doc_id, text, CAST(0 AS BIGINT) AS start FROM documents WHERE len(coalesce(text, '')) > 0)
  UNION ALL
  SELECT doc_id, text, start, {{first}} FROM (SELECT doc_id, text, greatest(stop - 100, start + 1) AS start FROM fold WHERE stop < len(text)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_no, md5(piece) AS digest
FROM (SELECT doc_id, start, trim(substr(text, start + 1, stop - start), {BLANKS}) AS piece FROM fold) WHERE piece <> ''"""
_HALF = "substr(text, start + 2001, 2000)"
SOUGHT = SOUGHT.format(
    first=rf"""CASE WHEN start + 4000 >= len(text) THEN start + 4000 WHEN contains({_HALF}, e'\n\n') THEN start + 4000 - instr(reverse({_HALF}), e'\n\n')
    WHEN contains({_HALF}, '. ') THEN start + 4000 - instr(reverse({_HALF}), ' .') ELSE start + 4000 END"""
)


def grounded(bm25: str) -> str:
    """Prompts over the first four passages of each question. bm25: tables that end in kw."""
    rules = retrieval.PROMPT_RULES.replace("\n", "' || e'\\n' || '")
    return f"""WITH {bm25}, s AS (SELECT qid, count(*) AS n, string_agg('[S' || (rank0 + 1) || '] ' || d.source || ' / ' || d.lang || e'\\n' || substr(d.text, 1, 1000), e'\\n\\n' ORDER BY rank0) AS sources
      FROM kw JOIN documents d ON d.doc_id = kw.key WHERE rank0 < 4 GROUP BY qid)
    SELECT qid, CAST(n AS INTEGER) AS n_passages, md5('{rules}' || sources || e'\\n\\nQuestion: ' || b.text) AS digest FROM s JOIN benchmark b ON b.item_id = qid"""


# Notes on at most ten windows of 400 words, as the mock writes them.
MATERIAL = f"""WITH w AS (SELECT doc_id, trim(text, {BLANKS}) AS t, {words('text')} AS ws, {word_count('text')} AS n FROM documents WHERE {word_count('text')} > 0),
c AS (SELECT *, 1 + CAST(ceil(greatest(n - 400, 0) / 400) AS BIGINT) AS c FROM w),
win AS (SELECT doc_id, i, c, CASE WHEN n <= 400 THEN t ELSE array_to_string(ws[i * 400 + 1 : i * 400 + 400], ' ') END AS x FROM (SELECT *, unnest(range(0, c)) AS i FROM c)),
kept AS (SELECT * FROM win WHERE c <= 10 OR i < 2 OR list_contains(list_transform(range(0, 8), lambda k: CAST(floor(k * ((c - 2) / 8.0)) AS BIGINT) + 2), i)),
notes AS (SELECT doc_id, i, '{{"title":"Mock title","issuing_body":"Mock body","country_or_region":"Not stated","year":"unknown","document_type":"Report","summary":' ||
  CAST(to_json(array_to_string(({words('x')})[1:60], ' ')) AS VARCHAR) || ',"keywords":["skills","training","policy"]}}' AS note FROM kept)
SELECT doc_id, md5(string_agg(note, e'\\n\\n' ORDER BY i)) AS digest FROM notes GROUP BY doc_id"""


def md5_number(x: str, digits: int = 2) -> str:
    """The first digits of a text's MD5 as a number."""
    return " + ".join(f"(instr('0123456789abcdef', substr(md5({x}), {i + 1}, 1)) - 1) * {16 ** (digits - 1 - i)}" for i in range(digits))


VECTORS = f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
n AS (SELECT item_id, ({md5_number('term')}) % 64 AS place, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT item_id, sqrt(sum(n * n)) AS size FROM n GROUP BY item_id)
SELECT b.item_id, i AS place, round(coalesce(n.n / s.size, 0), 6) AS value FROM benchmark b CROSS JOIN (SELECT unnest(range(0, 64)) AS i) LEFT JOIN n ON n.item_id = b.item_id AND n.place = i LEFT JOIN s ON s.item_id = b.item_id"""

# Pages as records: the summary is the page's whole text, so its length decides most of them.
_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
RECORDS = f"SELECT page_id, array_to_string({summary_errors('body')}, '; ') AS errors, 3 AS keywords FROM (SELECT page_id, {_BODY} AS body FROM pages)"
