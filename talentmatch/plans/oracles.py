"""DuckDB oracle SQL for every registered query with a SQL form.

Written independently of the Spark plans, over the pre-registered base
tables; derived views are inlined as ``WITH`` clauses from the same SQL
text Spark runs.  RE2 (DuckDB) has no lookaround, so Python word
boundaries are spelled with consuming classes where a match is only tested
or where the boundary character cannot be part of the wanted group.
"""

from __future__ import annotations

from talentmatch.functions import constants as K
from talentmatch.sources.fixtures import view_sql

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
W = r"\p{L}\p{N}_"
SCRAPE_DATE = "2025-08-17"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


# -- column expressions -------------------------------------------------------

def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank(x: str) -> str:
    return f"coalesce(length(regexp_replace({x}, '{WS}+', '', 'g')) = 0, true)"


def clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), "
            rf"'[^{W} @.+()\-]', ' ', 'g'))")


TWO = "([A-Za-z]{2,} [A-Za-z]{2,})"


def name(c: str) -> str:
    return (f"coalesce(nullif(regexp_extract({c}, '^{TWO}', 1), ''), "
            f"nullif(regexp_extract({c}, '(?:^|[^{W}]){TWO}(?:$|[^{W}])', 1), ''), "
            f"nullif(regexp_extract({c}, '(?i)name[: ]*{TWO}', 1), ''), {lit(K.UNKNOWN_NAME)})")


def email(c: str) -> str:
    return rf"regexp_extract({c}, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{{2,}}\b', 0)"


def phone(c: str) -> str:
    return (rf"regexp_extract({c}, '\b(?:\+\d{{1,2}}\s?)?\(?\d{{3}}\)?[\s.\-]?\d{{3}}"
            rf"[\s.\-]?\d{{4}}\b', 0)")


def section_text(c: str, kw: str) -> str:
    return rf"trim(regexp_extract({c}, '(?is){kw}[:\s]*(.*)', 1))"


def trunc(x: str, n: int) -> str:
    return f"(case when length({x}) > {n} then substr({x}, 1, {n}) || '...' else {x} end)"


def tail(c: str) -> str:
    return f"lower(regexp_extract({c}, '(?is)skills[:\\s]*(.*)', 1))"


def _escape(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\-" else ch for ch in s)


def skills(lc: str, tl: str) -> str:
    items = []
    for s in K.SKILL_LEXICON:
        before = f"(^|[^{W}])" if (s[0].isalnum() or s[0] == "_") else f"[{W}]"
        after = f"($|[^{W}])" if (s[-1].isalnum() or s[-1] == "_") else f"[{W}]"
        pat = before + _escape(s) + after
        items.append(f"case when contains({lc}, {lit(s)}) and (regexp_matches({lc}, {lit(pat)}) "
                     f"or contains({tl}, {lit(s)})) then {lit(s.title())} end")
    return "list_sort(list_filter([" + ", ".join(items) + "], lambda x: x is not null))"


def parse_select(src: str, id_col: str, text: str = "text", extra: str = "") -> str:
    """SELECT producing the parse record of every row of ``src``."""
    extra_cols = (extra + ", ") if extra else ""
    return f"""select {id_col}, {extra_cols}
  case when not b then {name('c')} end name,
  case when not b then {email('c')} end email,
  case when not b then {phone('c')} end phone,
  case when not b then {skills('lc', 'tl')} end skills,
  case when not b then {section_text('c', 'experience')} end experience,
  case when not b then {section_text('c', 'education')} end education,
  case when not b then c end raw_text,
  case when not b then len end text_length,
  case when b then {lit(K.EMPTY_TEXT_ERROR)} end error
from (select *, lower(c) lc, {tail('c')} tl from (
  select {id_col}, {extra_cols}{blank(text)} b, cast(length({text}) as bigint) len, {clean(text)} c
  from {src}))"""


def meant_lines(x: str) -> str:
    blanks = r"[ \t\x0b\x0c\x1c-\x1f\x{85}\p{Z}]"
    x = rf"regexp_replace({x}, '\r\n?|[\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    x = f"regexp_replace({x}, '{blanks}+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, ' ?\n ?', chr(10), 'g')")


def meant_name(t: str) -> str:
    one = r"\p{Lu}\p{Ll}+(-\p{Lu}\p{Ll}+)?"
    tries = [rf"^({one} {one})($|[^{W}])", rf"(?:^|\n)(?:[nN][aA][mM][eE]) ?:? ?({one} {one})($|[^{W}])", rf"(?:^|[^{W}])({one} {one})($|[^{W}])"]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{p}', 1), '')" for p in tries) + f", {lit(K.UNKNOWN_NAME)})"


def meant_email(t: str) -> str:
    return rf"regexp_extract({t}, '(?:^|[^{W}.%+\-])([A-Za-z0-9_][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}})(?:$|[^{W}])', 1)"


def meant_phone(t: str) -> str:
    d = r"\p{Nd}"
    return (rf"regexp_extract({t}, '(?:^|[^{W}+])((?:\+{d}{{1,2}}[ .\-]?)?(?:\({d}{{3}}\)|{d}{{3}})[ .\-]?{d}{{3}}[ .\-]?{d}{{4}})(?:$|[^{W}])', 1)")


def meant_section(t: str, kw: str) -> str:
    """Lines after the heading up to a blank line or the next heading, by position."""
    rest = rf"regexp_extract({t}, '(?is)(?:^|\n){kw} ?(?::|\n)[:\s]*(.*)', 1)"
    return rf"regexp_extract({rest}, '(?s)^(.*?)(?:\n\n|\n[^\n:]{{1,40}}:|\z)', 1)"


def meant_skills(low: str) -> str:
    edge = f"[^{W}+#]"
    items = ", ".join(rf"case when regexp_matches({low}, {lit(f'(^|{edge})' + _escape(s).replace(' ', chr(92) + 's+') + f'($|{edge})')}) "
                      f"then {lit(s.title())} end" for s in K.SKILL_LEXICON)
    return f"list_sort(list_filter([{items}], lambda x: x is not null))"


def meant_parse(src: str, id_col: str) -> str:
    fields = {"name": meant_name("t"), "email": meant_email("t"), "phone": meant_phone("t"), "skills": meant_skills("lower(t)"),
              "experience": meant_section("t", "experience"), "education": meant_section("t", "education"), "raw_text": "t", "text_length": "len"}
    columns = ", ".join(f"case when not b then {x} end {n}" for n, x in fields.items())
    return (f"select {id_col}, {columns}, case when b then {lit(K.EMPTY_TEXT_ERROR)} end error from "
            f"(select {id_col}, {blank('text')} b, cast(length(text) as bigint) len, {meant_lines('text')} t from {src})")


def resume_text(sk: str, ex: str, ed: str) -> str:
    return strip(f"array_to_string(coalesce({sk}, []::VARCHAR[]), ' ') || ' ' || "
                 f"coalesce({ex}, '') || ' ' || coalesce({ed}, '')")


def clean_jobs_select(src: str) -> str:
    return (f"select job_id, {strip('lower(title)')} title, {strip('lower(company)')} company, "
            f"{strip('lower(location)')} location, link, "
            f"coalesce(cast(contains(lower({strip('lower(location)')}), 'remote') as int), 0) is_remote "
            f"from {src}")


def advice(sk: str, match_case: bool) -> str:
    s = f"coalesce({sk}, []::VARCHAR[])"
    if not match_case:
        s = f"list_transform({s}, lambda x: lower(x))"
    parts = [f"case when list_has_any({s}, {lst(trig)}) then {lst(lines)} else []::VARCHAR[] end"
             for trig, lines in K.ADVICE_RULES]
    lines = f"list_concat({parts[0]}, {parts[1]})"
    return (f"array_to_string(case when len({lines}) = 0 then {lst(K.ADVICE_DEFAULT)} "
            f"else {lines} end, chr(10) || chr(10))")


def prompt(sk: str, ex: str, ed: str) -> str:
    head, rest = K.ADVICE_PROMPT_TEMPLATE.split("{skills}")
    mid1, rest = rest.split("{experience}")
    mid2, tl = rest.split("{education}")
    ns = lit(K.ADVICE_NOT_SPECIFIED)
    return (f"({lit(head)} || array_to_string(coalesce({sk}, []::VARCHAR[]), ', ') || {lit(mid1)} || "
            f"coalesce({ex}, {ns}) || {lit(mid2)} || coalesce({ed}, {ns}) || {lit(tl)})")


def extension(f: str) -> str:
    return f"(case when contains({f}, '.') then lower(regexp_extract({f}, '[^.]*$', 0)) end)"


def admitted(f: str, size: str) -> str:
    exts = ", ".join(lit(e) for e in K.ALLOWED_EXTENSIONS)
    return (f"(coalesce({f} <> '', false) and coalesce({extension(f)} in ({exts}), false) "
            f"and coalesce({size} <= {K.MAX_UPLOAD_BYTES}, false))")


# -- common WITH clauses ---------------------------------------------------------

def with_views(*names: str) -> str:
    return ",\n".join(f"{n} as ({view_sql(n)})" for n in names)


PARSED = f"""{with_views('resumes_raw')},
parsed as ({parse_select('resumes_raw', 'resume_id')})"""

JOBS_CLEAN = f"""{with_views('jobs_raw')},
jobs_clean as ({clean_jobs_select('jobs_raw')}),
jobs_text as (select job_id, concat_ws(' ', title, company, location) text from jobs_clean)"""

UPLOADS = f"""{with_views('resumes_raw')},
uploads as ({view_sql('uploads')}),
up_parsed as (select *, {admitted('filename', 'size')} admitted, size > 16777216 too_large from
  ({parse_select('uploads', 'request_id', extra='filename, size')}))"""


def tfidf_ctes(res_text: str) -> str:
    """Ranked top-5 TF-IDF matches of résumé texts ``res_text(resume_id,
    text)`` against ``jobs_text``; defines ``ranked``."""
    tok = r"[\p{L}\p{N}_]{2,}"
    return f"""jtf as (select id, term, count(*) tf from (select job_id id,
    unnest(regexp_extract_all(lower(text), '{tok}')) term from jobs_text) group by id, term),
nj as (select count(*) n from jobs_text),
idf as (select term, ln((1.0 + max(nj.n)) / (1.0 + count(*))) + 1.0 idf from jtf, nj group by term),
jw0 as (select id, term, tf * idf w from jtf join idf using (term)),
jw as (select id, term, case when nrm > 0 then w / nrm else 0 end weight from jw0
       join (select id, sqrt(sum(w * w)) nrm from jw0 group by id) using (id)),
rtf as (select id, term, count(*) tf from (select resume_id id,
    unnest(regexp_extract_all(lower(text), '{tok}')) term from {res_text}) group by id, term),
rw0 as (select id, term, tf * idf w from rtf join idf using (term)),
rw as (select id, term, case when nrm > 0 then w / nrm else 0 end weight from rw0
       join (select id, sqrt(sum(w * w)) nrm from rw0 group by id) using (id)),
dots as (select r.id rid, j.id jid, sum(r.weight * j.weight) s from rw r join jw j using (term)
         group by r.id, j.id),
pairs as (select r.resume_id rid, j.job_id jid, round(least(greatest(coalesce(d.s, 0), -1), 1), 6) score
          from {res_text} r cross join jobs_text j left join dots d on d.rid = r.resume_id and d.jid = j.job_id),
ranked as (select rid resume_id, jid job_id, score match_score,
           cast(row_number() over (partition by rid order by score desc, jid) as int) rank from pairs
           qualify rank <= {K.DEFAULT_TOP_N})"""


DENSE = f"""e as (select vec_id, label, cast(embedding as double[]) v from embeddings),
r as (select vec_id resume_id, v from e where label = 0),
j as (select vec_id job_id, v from e where label <> 0),
pairs as (select resume_id, job_id, round(case when list_dot_product(r.v, r.v) > 0 and list_dot_product(j.v, j.v) > 0
   then list_dot_product(r.v, j.v) / (sqrt(list_dot_product(r.v, r.v)) * sqrt(list_dot_product(j.v, j.v))) else 0 end, 6) s
   from r cross join j),
dense as (select resume_id, job_id, s match_score,
   cast(row_number() over (partition by resume_id order by s desc, job_id) as int) rank from pairs
   qualify rank <= {K.DEFAULT_TOP_N})"""


def _open_tag(tag: str, token: str | None) -> str:
    if token is None:
        return rf"<(?i:{tag})(?:\s[^>]*)?>"
    double, single = rf'"(?:[^"]*\s)?{token}(?:\s[^"]*)?"', rf"'(?:[^']*\s)?{token}(?:\s[^']*)?'"
    return rf"<(?i:{tag})\s(?:[^>]*\s)?(?i:class)\s*=\s*(?:{double}|{single})[^>]*>"


def _element(tag, token):
    return rf"(?s){_open_tag(tag, token)}(.*?)</(?i:{tag})\s*>"


def _entities(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def _field(card: str, selectors, default: str) -> str:
    parts = []
    for tag, token in selectors:
        pat = lit(_element(tag, token))
        txt = strip(_entities(f"regexp_replace(regexp_extract({card}, {pat}, 1), '<[^>]*>', '', 'g')"))
        parts.append(f"when regexp_matches({card}, {pat}) then {txt}")
    return "case " + " ".join(parts) + f" else {lit(default)} end"


def _link(card: str, selectors):
    href = lit(r"""\s(?i:href)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
    link_parts, drop_parts = [], []
    for tag, token in selectors:
        pat = lit("(" + _open_tag(tag, token) + ")")
        opening = f"regexp_extract({card}, {pat}, 1)"
        value = f"regexp_extract({opening}, {href}, 1) || regexp_extract({opening}, {href}, 2)"
        link_parts.append(f"when regexp_matches({card}, {pat}) then split_part({_entities(f'({value})')}, '?', 1)")
        drop_parts.append(f"when regexp_matches({card}, {pat}) then not regexp_matches({opening}, {href})")
    return ("case " + " ".join(link_parts) + f" else {lit(K.MISSING_LINK)} end",
            "case " + " ".join(drop_parts) + " else false end")


def cards_from(pages: str, containers=K.CARD_CONTAINERS, title=K.CARD_TITLE, company=K.CARD_COMPANY,
               location=K.CARD_LOCATION, link=K.CARD_LINK) -> str:
    """CTEs up to ``cards``.  A segment ends where one more closing than
    opening tag of its container's kind has been seen."""
    splits = ", ".join(f"regexp_split_to_array(html, {lit(_open_tag(t, c))}) s{i}"
                       for i, (t, c) in enumerate(containers))
    kinds = " ".join(f"when len(s{i}) > 1 then {i}" for i in range(len(containers)))
    chosen = " ".join(f"when {i} then s{i}" for i in range(len(containers)))
    tags = [lit(rf"<(/?)(?i:{t})(?:\s[^>]*)?>") for t, _ in containers]
    marks = " ".join(f"when {i} then regexp_extract_all(seg, {t}, 1)" for i, t in enumerate(tags))
    pieces = " ".join(f"when {i} then regexp_split_to_array(seg, {t})" for i, t in enumerate(tags))
    href, drop = _link("card", link)
    return f"""sp as (select page_id, {splits} from {pages}),
kinds as (select *, case {kinds} end kind from sp),
seglists as (select page_id, kind, (case kind {chosen} end)[2:] segs from kinds where kind is not null),
segrows as (select page_id, kind, unnest(segs) seg, cast(generate_subscripts(segs, 1) - 1 as int) card_no from seglists),
cut as (select page_id, card_no, case kind {pieces} end parts,
  [case when x = '/' then -1 else 1 end for x in (case kind {marks} end)] steps from segrows),
ends as (select *, list_position([1 + list_sum(steps[1:i]) for i in range(1, len(steps) + 1)], 0) stop_at from cut),
cardrows as (select page_id, card_no, array_to_string(case when stop_at > 0 then parts[1:stop_at] else parts end, '') card from ends),
cards as (select page_id, card_no, {_field('card', title, K.MISSING_TITLE)} title,
  {_field('card', company, K.MISSING_COMPANY)} company,
  {_field('card', location, K.MISSING_LOCATION)} location, {href} link,
  {lit(K.SOURCE_HTML)} source, DATE '{SCRAPE_DATE}' date_scraped
  from cardrows where not ({drop}))"""


def cards_ctes() -> str:
    return f"{with_views('pages_jobs')},\n{cards_from('pages_jobs')}"


def feed_ctes() -> str:
    fields = ", ".join(f"case when json_exists(j, {lit('$.' + key)}) then j->>{lit(key)} else {lit(d)} end {n}"
                       for n, key, d in K.FEED_FIELDS)
    return f"""{with_views('feeds_raw')},
fa as (select feed_id, cast(body as json[]) arr from feeds_raw where body like '[%'),
fok as (select feed_id, arr from fa where list_bool_and(list_transform(arr, lambda x: json_type(x) = 'OBJECT'))),
fitems as (select feed_id, unnest(arr) j, cast(generate_subscripts(arr, 1) - 1 as int) item_no from fok),
feed as (select feed_id, item_no, {fields}, {lit(K.SOURCE_FEED)} source, DATE '{SCRAPE_DATE}' date_scraped from fitems)"""


def _na(col: str) -> str:
    return f"case when {col} in ({', '.join(lit(v) for v in K.CSV_NA_VALUES)}) then null else {col} end"


LANDING = f"""landing as (select job_id, case when job_id % 11 = 0 then 'N/A' else title end title, company,
  location, link, {lit(K.SOURCE_HTML)} source, DATE '{SCRAPE_DATE}' date_scraped from jobs_raw)"""

DOCS_CLEAN = f"docs as (select doc_id, {clean('text')} c from documents)"

ORACLES: dict[str, str] = {
    # C: parsing
    "clean_text": f"select doc_id, {clean('text')} clean_text from documents",
    "extract_name": f"with {DOCS_CLEAN} select doc_id, {name('c')} name from docs",
    "extract_email": f"with {DOCS_CLEAN} select doc_id, {email('c')} email from docs",
    "extract_phone": f"with {DOCS_CLEAN} select doc_id, {phone('c')} phone from docs",
    "extract_skills": f"with {DOCS_CLEAN}, d2 as (select doc_id, lower(c) lc, {tail('c')} tl from docs) "
                      f"select doc_id, array_to_string({skills('lc', 'tl')}, ', ') skills from d2",
    "extract_section": f"with {DOCS_CLEAN} select doc_id, {trunc(section_text('c', 'that'), 200)} section from docs",
    "truncate_text": f"with {DOCS_CLEAN} select doc_id, {trunc('c', 500)} raw_text from docs",
    "text_stats": "select doc_id, cast(length(text) as bigint) text_length, "
                  "'doc_' || cast(doc_id as varchar) || '.txt' file from documents",
    "parse_errors": f"with {UPLOADS} select request_id, error from up_parsed where error is not null",
    "parse_resumes": f"with {PARSED} select resume_id, name, email, phone, array_to_string(skills, ', ') skills, "
                     "experience, education, raw_text, text_length, error from parsed",
    "parse_resumes_intended": f"with {with_views('resumes_raw')}, parsed as ({meant_parse('resumes_raw', 'resume_id')}) "
                              "select * replace (array_to_string(skills, ', ') as skills) from parsed",
    "extract_skills_intended": f"with d as (select doc_id, lower({meant_lines('text')}) t from documents) "
                               f"select doc_id, array_to_string({meant_skills('t')}, ', ') skills from d",
    "extract_name_intended": f"with d as (select doc_id, {meant_lines('text')} t from documents) "
                             f"select doc_id, {meant_name('t')} name, {meant_email('t')} email, {meant_phone('t')} phone from d",
    # B: projections
    "clean_jobs": f"with {JOBS_CLEAN} select job_id, title, company, location, link, is_remote from jobs_clean",
    "flag_remote": f"with {with_views('jobs_raw')} select job_id, "
                   "coalesce(cast(contains(lower(location), 'remote') as int), 0) is_remote from jobs_raw",
    "canonical_link": f"with {with_views('jobs_raw')} select job_id, split_part(link, '?', 1) link from jobs_raw",
    "job_text": f"with {JOBS_CLEAN} select job_id, text from jobs_text",
    "resume_text": f"with {PARSED} select resume_id, {resume_text('skills', 'experience', 'education')} text "
                   "from parsed where error is null",
    "default_fields": f"with {DENSE} select resume_id, job_id, 'N/A' title, 'N/A' company, 'N/A' location, "
                      "'#' link, match_score from dense",
    "manual_profiles": f"""with {with_views('forms_raw')},
f as (select request_id, {strip("coalesce(skills, '')")} raw, experience, education from forms_raw)
select request_id, {lit(K.MANUAL_PROFILE_NAME)} name, '' email,
  array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: {strip('x')}), lambda x: x <> ''), ', ') skills,
  cast(len(list_filter(list_transform(string_split(raw, ','), lambda x: {strip('x')}), lambda x: x <> '')) as int) n_skills,
  {strip("coalesce(experience, '')")} experience, {strip("coalesce(education, '')")} education
from f where raw <> ''""",
    "score_band": f"with {DENSE} select resume_id, job_id, case when match_score >= 0.7 then 'high' "
                  "when match_score >= 0.5 then 'medium' else 'low' end band from dense",
    "score_pct": f"with {DENSE} select resume_id, job_id, "
                 "cast(cast(round_even(match_score * 100, 0) as bigint) as varchar) || '%' pct from dense",
    "profile_summary": f"with {PARSED} select resume_id, array_to_string(skills, ', ') skills_summary, "
                       f"replace({advice('skills', False)}, chr(10), '<br>') advice_html from parsed",
    # E: advice
    "career_advice": f"with {PARSED} select resume_id, {advice('skills', True)} advice from parsed",
    "career_advice_intended": f"with {PARSED} select resume_id, {advice('skills', False)} advice from parsed",
    "advice_prompt": f"with {PARSED} select resume_id, {prompt('skills', 'experience', 'education')} prompt from parsed",
    # D: features and matching
    "tfidf_weights": f"""with {JOBS_CLEAN}, {tfidf_ctes('jobs_text')}
select id job_id, term, round(weight, 6) weight from jw""",
    "cosine_pairs": """with e as (select vec_id, cast(embedding as double[]) v from embeddings)
select a.vec_id, b.vec_id next_vec_id, round(case when list_dot_product(a.v, a.v) > 0 and list_dot_product(b.v, b.v) > 0
  then list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) else 0 end, 6) cosine
from e a join e b on b.vec_id = a.vec_id + 1""",
    "match_topk_dense": f"with {DENSE} select resume_id, job_id, rank, match_score from dense",
    "match_topk_dense_pruned": f"with {DENSE} select resume_id, job_id, rank, match_score from dense",
    "match_single": f"with {DENSE} select resume_id, job_id, s match_score from pairs "
                    f"where resume_id = (select min(resume_id) from r) order by s desc, job_id limit {K.DEFAULT_TOP_N}",
    "blend_bands": """with e as (select vec_id, cast(embedding as double[]) v from embeddings),
p as (select a.vec_id, a.v, [x[1] + x[2] * (a.vec_id % 7) / 2.0 for x in list_zip(a.v, b.v)] w
  from e a join e b on b.vec_id = a.vec_id + 1),
s as (select vec_id, round(case when list_dot_product(v, v) > 0 and list_dot_product(w, w) > 0 then
  list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))) else 0 end, 6) score from p)
select vec_id, score, case when score >= 0.7 then 'high' when score >= 0.5 then 'medium' else 'low' end band,
  cast(cast(round_even(score * 100, 0) as bigint) as varchar) || '%' pct from s""",
    "section_text": f"with {DOCS_CLEAN} select doc_id, {section_text('c', 'that')} section from docs",
    "display_resumes": f"with {PARSED} select resume_id, name, {trunc('experience', 200)} experience, "
                       f"{trunc('education', 200)} education, {trunc('raw_text', 500)} raw_text from parsed",
    "parse_resume_files": f"""with {with_views('resumes_raw')},
landed as (select resume_id, text || chr(10) text from resumes_raw),
parsed as ({parse_select('landed', 'resume_id')})
select resume_id, name, email, phone, array_to_string(skills, ', ') skills, experience, education, text_length, error from parsed""",
    "canonical_url": "select page_id, split_part(url, '?', 1) url from pages",
    "job_counts": f"""with {with_views('jobs_raw')},
t as (select case when job_id % 97 = 0 then '' else concat_ws(' ', {strip("lower(case when job_id % 2 <> 0 then title else ' ' end)")},
  {strip("lower(case when job_id % 3 <> 0 then company else ' ' end)")}, {strip("lower(case when job_id % 5 <> 0 then location else ' ' end)")}) end x from jobs_raw)
select count(*) filter (not {blank('x')}) n_jobs, count(*) filter ({blank('x')}) n_without_text from t""",
}


def _tfidf_with(res_cte_prefix: str, res_text_sql: str) -> str:
    return f"""with {res_cte_prefix}, {JOBS_CLEAN},
res_text as ({res_text_sql}),
{tfidf_ctes('res_text')}"""


_RES_FROM_PARSED = (f"select resume_id, {resume_text('skills', 'experience', 'education')} text "
                    "from parsed where error is null")
ORACLES["match_topk_tfidf"] = (_tfidf_with(PARSED, _RES_FROM_PARSED)
                               + "\nselect resume_id, job_id, rank, match_score from ranked")
ORACLES["match_topk_tfidf_pruned"] = ORACLES["match_topk_tfidf"]
ORACLES["match_stats"] = (_tfidf_with(PARSED, _RES_FROM_PARSED)
                          + "\nselect resume_id, count(*) n_matches, max(match_score) top_score, "
                            "(select count(*) from jobs_text) n_jobs from ranked group by resume_id")
_SHOWN = """
select m.resume_id, m.rank, m.job_id, j.title, j.company, j.location, j.link, m.match_score,
  case when match_score >= 0.7 then 'high' when match_score >= 0.5 then 'medium' else 'low' end band,
  cast(cast(round_even(match_score * 100, 0) as bigint) as varchar) || '%' pct
from ranked m join jobs_clean j using (job_id)"""
ORACLES["match_results"] = _tfidf_with(PARSED, _RES_FROM_PARSED) + _SHOWN
ORACLES["match_results_intended"] = _tfidf_with(
    f"{with_views('resumes_raw')}, parsed as ({meant_parse('resumes_raw', 'resume_id')})", _RES_FROM_PARSED) + _SHOWN
ORACLES["roundtrip_matches"] = (_tfidf_with(PARSED, _RES_FROM_PARSED) + """
select m.resume_id, m.rank, m.job_id, j.title, j.company, j.location, j.link, m.match_score
from ranked m join jobs_clean j using (job_id)""")

_UP_TEXT = (f"select request_id resume_id, {resume_text('skills', 'experience', 'education')} text "
            "from up_parsed where error is null")
ORACLES["unmatched_resumes"] = (_tfidf_with(UPLOADS, _UP_TEXT) + """,
st as (select resume_id, count(*) n_matches, max(match_score) top_score from ranked group by resume_id)
select p.request_id resume_id, coalesce(st.n_matches, 0) n_matches, st.top_score,
  case when st.n_matches is not null then 'matched' else coalesce(p.error, 'no matches') end status
from up_parsed p left join st on st.resume_id = p.request_id""")


def resolved_ctes(files: str = "up_parsed", forms: str = "forms_raw") -> str:
    """CTEs up to ``resolved``: a profile or a rejection per request."""
    return f"""j as (select coalesce(p.request_id, f.request_id) request_id, p.admitted f_admitted, coalesce(p.too_large, false) refused, p.name f_name, p.email f_email,
  p.skills f_skills, p.experience f_experience, p.education f_education, p.error f_error,
  f.skills m_skills, f.experience m_experience, f.education m_education
  from {files} p full outer join {forms} f on p.request_id = f.request_id),
k as (select *, not coalesce(refused, false) and coalesce(f_admitted, false) use_file,
  {strip("coalesce(m_skills, '')")} m_raw from j),
flags as (select *, use_file and f_error is null file_ok, use_file and f_error is not null file_bad,
  not coalesce(refused, false) and not use_file and m_skills is not null and m_raw <> '' form_ok,
  list_filter(list_transform(string_split(m_raw, ','), lambda x: {strip('x')}), lambda x: x <> '') m_list from k),
resolved as (select request_id,
  case when file_ok then 'file' when form_ok then 'form' end profile_source,
  case when file_ok then f_name when form_ok then {lit(K.MANUAL_PROFILE_NAME)} end name,
  case when file_ok then f_email when form_ok then '' end email,
  case when file_ok then f_skills when form_ok then m_list end skills,
  case when file_ok then f_experience when form_ok then {strip("coalesce(m_experience, '')")} end experience,
  case when file_ok then f_education when form_ok then {strip("coalesce(m_education, '')")} end education,
  case when refused then 'File too large. Please upload a file smaller than 16MB.'
       when file_bad then 'Resume parsing error: ' || f_error
       when not file_ok and not form_ok then 'Please either upload a resume or enter your skills' end rejection
  from flags)"""


_RESOLVED = f"{UPLOADS}, {with_views('forms_raw')}, {resolved_ctes()}"

ORACLES["resolve_profiles"] = (f"with {_RESOLVED} select request_id, profile_source, name, email, "
                               "array_to_string(skills, ', ') skills, experience, education, rejection from resolved")
ORACLES["gated_advice"] = (f"with {_RESOLVED} select request_id, case when profile_source = 'file' and "
                           f"coalesce(len(skills), 0) > 0 then {advice('skills', True)} end advice "
                           "from resolved where rejection is null")


def _answers(match_case: bool) -> str:
    gate = f"case when profile_source = 'file' and coalesce(len(skills), 0) > 0 then {advice('skills', match_case)} end"
    shown = {c: f"case when profile_source = 'file' then {trunc(c, K.SECTION_MAX_CHARS)} else {c} end" for c in ("experience", "education")}
    return f"""with {UPLOADS}, {with_views('forms_raw')}, {JOBS_CLEAN},
some_files as (select * from up_parsed where request_id % 23 <> 0),
some_forms as (select coalesce(f.request_id, p.request_id) request_id, f.skills, f.experience, f.education
  from (select * from forms_raw where request_id % 5 <> 0) f full outer join some_files p on p.request_id = f.request_id),
{resolved_ctes('some_files', 'some_forms')},
res_text as (select request_id resume_id, {resume_text('skills', 'experience', 'education')} text from resolved where rejection is null),
{tfidf_ctes('res_text')},
lines as (select m.resume_id request_id, count(*) n, max(match_score) top_score, string_agg(concat_ws(' | ', rank, title, company, location,
    cast(cast(round_even(match_score * 100, 0) as bigint) as varchar) || '%',
    case when match_score >= 0.7 then 'high' when match_score >= 0.5 then 'medium' else 'low' end, link), chr(10) order by rank) jobs
  from ranked m join jobs_clean using (job_id) group by m.resume_id)
select request_id, profile_source, name, email, array_to_string(skills, ', ') skills, {shown['experience']} experience,
  {shown['education']} education, replace({gate}, chr(10), '<br>') advice_html, cast(coalesce(n, 0) as int) n_jobs, top_score, jobs,
  coalesce(rejection, case when n is null then 'No AI-matched jobs found.' end) message
from resolved left join lines using (request_id)"""


ORACLES["answer_requests"] = ORACLES["stream_requests"] = _answers(True)
ORACLES["answer_requests_intended"] = _answers(False)

# A: sources and sinks
ORACLES["scan_jobs_csv"] = f"""with {with_views('jobs_raw')}, {LANDING}
select job_id, {_na('title')} title, {_na('company')} company, {_na('location')} location, {_na('link')} link,
  {_na('source')} source, date_scraped from landing"""
ORACLES["roundtrip_jobs"] = f"""with {with_views('jobs_raw')}, {LANDING},
c as (select job_id, {strip('lower(title)')} title, {strip('lower(company)')} company,
  {strip('lower(location)')} location, link, source, date_scraped from landing)
select job_id, {_na('title')} title, {_na('company')} company, {_na('location')} location, {_na('link')} link,
  {_na('source')} source, date_scraped, coalesce(cast(contains(lower(location), 'remote') as int), 0) is_remote from c"""
ORACLES["default_jobs"] = f"with {JOBS_CLEAN} select title, company, location, link from jobs_clean"
ORACLES["scan_resume_text"] = ("select doc_id, cast(length(t) as bigint) n_chars, md5(t) text_md5 from "
                               "(select doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') t from documents)")
ORACLES["resume_text_fallback"] = f"""with {with_views('resumes_raw')}, uploads as ({view_sql('uploads')}),
x as (select request_id, text, case when {extension('filename')} in ('pdf', 'docx') and request_id % 3 <> 0
  then text || chr(10) end extracted from uploads)
select request_id, cast(length(coalesce(extracted, regexp_replace(text, '\\r\\n?', chr(10), 'g'))) as bigint) text_length,
  case when extracted is not null then 'extracted' else 'decoded' end via from x"""
ORACLES["read_uploads"] = f"""with {with_views('resumes_raw')}, uploads as ({view_sql('uploads')})
select request_id, cast(length(text) as bigint) text_length, md5(text) text_md5,
  case when {extension('filename')} = 'docx' and request_id % 5 <> 0 then 'extracted' else 'decoded' end via from uploads"""
# a PDF's text: lines without outer or repeated blanks, blank lines left out, each page ends its last line
ORACLES["read_pdf_files"] = f"with {with_views('resumes_raw')}, " + r"""l as (select resume_id, text, [y for y in
  [trim(regexp_replace(x, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g')) for x in string_split(text, chr(10))] if y <> ''] lines from resumes_raw),
r as (select resume_id, case when resume_id % 7 = 0 then regexp_replace(text, '\r\n?', chr(10), 'g')
  when len(lines) = 0 then '' else array_to_string(lines, chr(10)) || chr(10) end t from l)
select resume_id, cast(length(t) as bigint) text_length, md5(t) text_md5,
  case when resume_id % 7 = 0 then 'decoded' else 'extracted' end via from r"""
ORACLES["parse_uploads"] = f"""with {UPLOADS} select request_id, case when error is null then filename end file, name, email, phone,
  array_to_string(skills, ', ') skills, experience, education, text_length, error from up_parsed where admitted"""
ORACLES["admit_uploads"] = (f"with {with_views('resumes_raw')}, uploads as ({view_sql('uploads')}) "
                            f"select request_id, filename, {admitted('filename', 'size')} admitted from uploads")
ORACLES["extract_cards"] = f"with {cards_ctes()} select * from cards"
ORACLES["flatten_job_feed"] = f"with {feed_ctes()} select * from feed"
ORACLES["first_nonempty_source"] = f"""with {cards_ctes()}, {feed_ctes()},
u as (select title, company, location, link, source, date_scraped, 0 prio from cards
      union all select title, company, location, link, source, date_scraped, 1 prio from feed)
select title, company, location, link, source, date_scraped from u where prio = (select min(prio) from u)"""
ORACLES["stream_job_snapshot"] = f"""with {cards_ctes()}
select page_id, card_no, {strip('lower(title)')} title, {strip('lower(company)')} company,
  {strip('lower(location)')} location, link, source, DATE '2025-08-17' date_scraped,
  coalesce(cast(contains(lower({strip('lower(location)')}), 'remote') as int), 0) is_remote
from cards where page_id % 2 = 1"""

_DEFAULTS = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in K.DEFAULT_JOBS)
ORACLES["default_jobs_empty"] = f"select * from (values {_DEFAULTS}) t(title, company, location, link)"
ORACLES["empty_jobs_csv"] = f"""with {with_views('jobs_raw')}, {LANDING}
select title, company, location, link, source, date_scraped from landing where false"""
ORACLES["fallback_to_feed"] = f"with {feed_ctes()} select title, company, location, link, source, date_scraped from feed"
ORACLES["page_cards"] = f"""with {cards_from('pages', (('li', None),), (('a', None),), link=(('a', None),))}
select page_id, card_no, title, location, link from cards"""
