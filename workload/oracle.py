"""The same questions in SQL over the given tables.

The steps are other ones than the plans take (windows over all words instead of hits, joins instead of
salts), and the published constants are written out again. The rule lists that the workload adds, and
the projections of the tables, are shared with it: a fault in those shows in tests/ only, which hold
the operators against published sentences and brute force.
"""

from __future__ import annotations

from workload import projections as P

# Fixed values of the published scorer.
STEP, CAPS, NEGATED, DAMPING = 0.293, 0.733, -0.74, (1.0, 0.95, 0.9)
# The settings of the reports.
DAY, KARMA, YEARS, SILENCE_DAYS, BURST_DAYS = 86400, 500, 0.5, 3, 1

# Whitespace, as the inside of a character class.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_lit(w) for w in sorted(words)) + ")"


def _sub(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {_lit(pattern)}, {_lit(replacement)}, 'g')"


def _strip(text: str) -> str:
    return _sub(text, rf"\A[{_WS}]+|[{_WS}]+\z", "")


def _pieces(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {_lit(f'[{_WS}]+')}), lambda x: x <> '')"


def _fused(text: str) -> str:
    for pair in ("(can)(not)", "(gim|lem)(me)", "(gon|wan)(na)", "(got)(ta)"):
        text = _sub(text, rf"(?i)\b{pair}\b", r"\1 \2")
    return text


def _words_only(text: str) -> str:
    return _sub(f"lower({text})", rf"[^\p{{L}}\p{{N}}_{_WS}]+", "")


def _tokens(text: str) -> str:
    for pattern, replacement in (
        (r"([«“‘„]|`+)", r" \1 "),
        (r'(^|[ (\[{<])"', r"\1 `` "),
    ):
        text = _sub(text, pattern, replacement)
    text = _sub(text, rf"[{_WS}]", " ")
    for pattern, replacement in (
        (r"""([^. ])\.(["')\]}>»”’]*)( |$)""", r"\1 . \2 \3"),
        (r"([:,])([^\d]|$)", r" \1 \2"),
        (r"(\.\.+)", r" \1 "),
        (r"([;@#$%&?!*\[\](){}<>])", r" \1 "),
        (r"(--)", r" \1 "),
        (r"([»”’])", r" \1 "),
        (r'"', r" '' "),
        (r"([^' ])('[sSmMdD]|')( |$)", r"\1 \2 \3"),
        (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)( |$)", r"\1 \2 \3"),
    ):
        text = _sub(text, pattern, replacement)
    return _pieces(_fused(text))


def _clean_tokens(text: str) -> str:
    return _pieces(_fused(_words_only(text)))


def _ratio(toks: str) -> str:
    return f"(case when len({toks}) = 0 then 0.0 else len(list_distinct({toks}))::double / len({toks}) end)::double"


def _bigrams(toks: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, least(len({toks}), 6)), "
        f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]), ', ')"
    )


_LABEL = "case when c >= 0.05 then 'Positive' when c <= -0.05 then 'Negative' else 'Neutral' end"
_DIVERSITY = (
    "case when n = 0 then 'No text' when r > 0.7 then 'Highly diverse' "
    "when r > 0.4 then 'Moderately diverse' else 'Less diverse' end"
)

_NAMES = dict.fromkeys(("customer", "pages", "documents", "events"))
_NAMES = {k: k for k in _NAMES}
_BASE = {
    "users": P.USERS.format(**_NAMES),
    "submissions": P.SUBMISSIONS.format(**_NAMES),
    "comments_raw": P.COMMENTS_RAW.format(**_NAMES),
    "comments": P.COMMENTS.format(**_NAMES),
    "peoples": P.PEOPLES.format(**_NAMES),
    "activity": P.ACTIVITY_CHECK.format(**_NAMES),
    "lexicon": f"""
        select token, v::double as v from (
          select token, ((length(token) * 7 + ascii(token)) % 17 - 8) / 2.0 as v
          from (select distinct unnest({_clean_tokens('text')}) as token from benchmark)
        ) where length(token) >= 4 and v <> 0""",
    "gazetteer": f"""
        select phrase, min(label) as label, len(string_split(phrase, ' ')) as n from (
          select unnest([array_to_string(t[1:1 + item_id % 4], ' '), array_to_string(t[3:3 + item_id % 3], ' ')]) as phrase,
            ['GPE', 'ORGANIZATION', 'PERSON'][item_id % 3 + 1] as label
          from (select item_id, {_tokens('text')} as t from benchmark)
        ) where regexp_matches(phrase, '^\\p{{Lu}}[\\p{{L}} ]*$') group by phrase""",
}


def _sql(body: str, *uses: str, **more: str) -> str:
    """`body` with the named projections (and further steps) in front."""
    steps = [f"fx_{u} as ({_BASE[u]})" for u in uses] + [f"{k} as ({v})" for k, v in more.items()]
    return f"with {', '.join(steps)} {body}" if steps else body


def _sentiment_steps(source: str, key: str, text: str, prefix: str) -> dict[str, str]:
    """Rule-based compound score, occurrence by occurrence, with window functions."""
    r = P.RULES
    singles = [w for w in r.raising | r.lowering if " " not in w]
    pairs = [w for w in r.raising | r.lowering if " " in w]
    marks = r"""(?:[.!?,;:'"-]|!!!?|\?\?\??|\?!\?!?|!\?!\??)"""
    word = r"([^[:punct:]]{2,})"
    freed = (
        f"list_transform(list_filter({_pieces('t')}, lambda x: length(x) > 1), "
        f"lambda x: regexp_replace(x, {_lit(f'^{marks}{word}$|^{word}{marks}$')}, '\\1\\2'))"
    )
    caps = "(upper({0}) = {0} and lower({0}) <> {0})"
    p = prefix

    def idiom(*places: str) -> str:
        phrase = " || ' ' || ".join(places)
        cases = " ".join(f"when {_lit(k)} then {v}" for k, v in r.idioms.items())
        return f"case {phrase} {cases} end"

    def step(i: int, special: str) -> str:
        low, raw = f"lower(p{i})", f"p{i}"
        base = f"case when {low} in {_list(r.raising)} then {STEP} when {low} in {_list(r.lowering)} then -{STEP} end"
        shout = f"case when mixed and {caps.format(raw)} then case when v > 0 then {CAPS} else -{CAPS} end else 0 end"
        weight = f"coalesce(case when v < 0 then -({base}) else {base} end + {shout}, 0) * {DAMPING[i - 1]}"
        negated = f"{low} in {_list(r.negations)} or contains({low}, 'n''t')"
        factor = f"case {special} when {negated} then {NEGATED} else 1.0 end"
        return f"((v + {weight})::double * ({factor})::double)::double"

    soothing = "p1 in ('so', 'this')"
    sp2 = f"when p2 = 'never' and {soothing} then 1.5"
    sp3 = f"when (p3 = 'never' and p2 in ('so', 'this')) or {soothing} then 1.25"
    before = ", ".join(
        idiom(*x) for x in (("p1", "w"), ("p2", "p1", "w"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))
    )
    hedge = f"case when p3 || ' ' || p2 in {_list(pairs)} or p2 || ' ' || p1 in {_list(pairs)} then -{STEP} else 0.0 end"
    keep = "id, pos, w, p1, p2, p3, x1, x2, k1, k2, k3, mixed, emphasis, part"
    return {
        f"{p}texts": f"select {key} as id, {text} as t, {freed} as ws from {source}",
        f"{p}facts": f"""
            select id, len(list_filter(ws, lambda x: {caps.format('x')})) between 1 and len(ws) - 1 as mixed,
              list_position(list_transform(ws, lambda x: lower(x)), {_lit(r.contrast)}) as turn,
              least(length(t) - length(replace(t, '!', '')), 4) * 0.292
                + case when length(t) - length(replace(t, '?', '')) > 3 then 0.96
                  when length(t) - length(replace(t, '?', '')) > 1 then (length(t) - length(replace(t, '?', ''))) * 0.18
                  else 0 end as emphasis
            from {p}texts""",
        f"{p}words": f"select id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as pos from {p}texts",
        f"{p}near": f"""
            select *, lag(w, 1) over o as p1, lag(w, 2) over o as p2, lag(w, 3) over o as p3,
              lead(w, 1) over o as x1, lead(w, 2) over o as x2
            from {p}words window o as (partition by id order by pos)""",
        f"{p}hits": f"""
            select n.*, l.v as v0, mixed, emphasis::double as emphasis,
              case when turn is null or turn = 0 or pos = turn then 1.0 when pos < turn then 0.5 else 1.5 end as part,
              lower(p1) in (select token from fx_lexicon) as k1, lower(p2) in (select token from fx_lexicon) as k2,
              lower(p3) in (select token from fx_lexicon) as k3
            from {p}near n join fx_lexicon l on lower(w) = l.token join {p}facts f using (id)""",
        f"{p}v0": f"""
            select {keep}, case when mixed and {caps.format('w')} then case when v0 > 0 then v0 + {CAPS} else v0 - {CAPS} end
              else v0 end::double as v from {p}hits""",
        f"{p}v1": f"select {keep}, case when p1 is not null and not k1 then {step(1, '')} else v end as v from {p}v0",
        f"{p}v2": f"select {keep}, case when p2 is not null and not k2 then {step(2, sp2)} else v end as v from {p}v1",
        f"{p}v3": f"""
            select {keep}, case when p3 is not null and not k3 then
              coalesce({idiom('w', 'x1', 'x2')}, {idiom('w', 'x1')}, {before}, {step(3, sp3)})::double + {hedge} else v end as v
            from {p}v2""",
        f"{p}v4": f"""
            select id, pos, w, emphasis, part, (case when lower(w) in {_list(singles)} or (lower(w) = 'kind' and lower(x1) = 'of') then 0.0
              when lower(p1) = 'least' and not k1 and coalesce(lower(p2) not in ('at', 'very'), true) then v * {NEGATED}
              else v end)::double as v
            from {p}v3""",
        f"{p}first": f"select *, first_value(v) over (partition by id, w order by pos) as fv from {p}v4",
        f"{p}sums": f"select id, sum((fv * part)::decimal(28,12))::double as s, any_value(emphasis) as e from {p}first group by id",
        f"{p}scores": f"""
            select id, round(s / sqrt(s * s + 15), 4)::double as c from (
              select id, case when s > 0 then s + e when s < 0 then s - e else 0.0 end::double as s from {p}sums)""",
    }


def _entity_steps(source: str, key: str, text: str, prefix: str) -> dict[str, str]:
    p = prefix
    return {
        f"{p}toks": f"select {key} as id, {_tokens(text)} as t from {source}",
        f"{p}each": f"select id, unnest(t) as t0, unnest(range(1, len(t) + 1)) as pos from {p}toks",
        f"{p}next": f"""
            select id, pos, t0, lead(t0, 1) over o as t1, lead(t0, 2) over o as t2, lead(t0, 3) over o as t3
            from {p}each window o as (partition by id order by pos)""",
        f"{p}grams": f"""
            select id, pos, 1 as len, t0 as phrase from {p}next
            union all select id, pos, 2, t0 || ' ' || t1 from {p}next where t1 is not null
            union all select id, pos, 3, t0 || ' ' || t1 || ' ' || t2 from {p}next where t2 is not null
            union all select id, pos, 4, t0 || ' ' || t1 || ' ' || t2 || ' ' || t3 from {p}next where t3 is not null""",
        f"{p}found": f"select g.id, g.pos, g.len, g.phrase, z.label from {p}grams g join fx_gazetteer z using (phrase)",
        f"{p}longest": f"select * from {p}found qualify row_number() over (partition by id, pos order by len desc) = 1",
        f"{p}kept": f"""
            select *, max(pos + len) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as busy
            from {p}longest qualify busy is null or busy <= pos""",
        f"{p}ents": f"""
            select id, string_agg(phrase, ', ' order by pos) as words,
              string_agg('(' || label || ' ' || phrase || ')', ', ' order by pos) as brackets
            from {p}kept group by id""",
    }


def _dups(source: str, key: str, *columns: str) -> str:
    normal = ", ".join(f"lower({_strip(c)})" for c in columns)
    known = " and ".join(f"{c} is not null" for c in columns)
    return f"select {key} as id, {known} and count(*) over (partition by {normal}) > 1 as dup from {source}"


_AGE = f"(floor(({P.AS_OF} - created_utc) / 86400.0) / 365.25)::double"
_LOW = f"coalesce(total_karma < {KARMA}, false)"
_YOUNG = f"coalesce({_AGE} <= {YEARS}, false)"
_NUMBER = "regexp_extract(redditor, '(\\d+)$', 1)::bigint"
_LIMIT = 25
_NEWEST = f"""select * from fx_activity
  qualify row_number() over (partition by redditor, kind order by created_utc desc, item_id desc) <= {_LIMIT}"""
_FIRST = "select redditor, min(created_utc) as first_activity from fx_activity group by redditor"
_BURSTS = f"""
  select redditor, count(*) as burst_count, max(n)::bigint as max_burst_size from (
    select redditor, created_utc - lag(created_utc) over (partition by redditor order by created_utc) as gap,
      count(*) over (partition by redditor order by created_utc
        range between current row and {BURST_DAYS * DAY} following) as n
    from fx_activity
  ) where gap >= {SILENCE_DAYS * DAY} and n >= 2 group by redditor"""
_STORED = "(comment_score < 0 or substring(link_id, 2)::int % 5 = 0)"
_NEW_OPENING = f"""select c.* from fx_peoples c
  where not {_STORED} and c.comment_author in (select redditor from fx_users)"""
_BY_PEOPLE = "comment_author is not null and lower(comment_author) not in ('automoderator', 'reddit')"
_K = "substring(comment_id, 2)::int"
_LANDED_POSTS = f"""
  select *, {_K} as k, case when {_K} % 10 = 0 then body || ' (again)' else body end as last_body,
    {_BY_PEOPLE} and not {_STORED}
      and comment_author in (select redditor from fx_users where {{number}} % 19 <> 0) as opens
  from fx_comments"""
_COMMENT_COLUMNS = (
    "comment_id, comment_author, comment_created_utc, body, comment_score, is_submitter, edited, link_id"
)
_LANDED = f"""select *, {_NUMBER} as k from fx_users"""


def _scored(source: str, key: str, scores: str) -> str:
    """Every text with its score; texts without a known word score 0."""
    return f"""select {key} as id, c, printf('%.3f', c) || ' (' || {_LABEL} || ')' as shown
      from (select {key}, coalesce(c, 0.0)::double as c from {source} left join {scores} on id = {key})"""


def _comment_report() -> str:
    steps = {
        **_sentiment_steps("fx_comments", "comment_id", _strip("body"), "s_"),
        **_entity_steps("fx_comments", "comment_id", _strip("body"), "e_"),
        "scored": _scored("fx_comments", "comment_id", "s_scores"),
        "dups": _dups("fx_comments", "comment_id", "body"),
        "ld": f"""select id, {_bigrams('t')} as bigrams, {_ratio('ct')} as r, len(ct) as n
          from (select e_toks.id, t, {_clean_tokens('body')} as ct from fx_comments join e_toks on id = comment_id)""",
    }
    body = f"""
      select comment_id as "Comment ID", coalesce(comment_author, '') as "Author", comment_created_utc as "Created ON",
        body as "Body", comment_score as "Comment Score", is_submitter as "Is Submitter", edited as "Edited",
        link_id as "Submission ID", shown as "Sentiment", coalesce(words, '') as "Named Entities",
        printf('%.2f', r) || ' (' || {_DIVERSITY} || ')' as "Lexical Diversity",
        bigrams as "Common Bigrams", case when dup then 'Yes' else 'No' end as "Is Duplicate"
      from fx_comments
        join scored on scored.id = comment_id join ld on ld.id = comment_id join dups on dups.id = comment_id
        left join e_ents on e_ents.id = comment_id"""
    return _sql(body, "comments", "lexicon", "gazetteer", **steps)


def _submission_report() -> str:
    known = "select * from fx_submissions where author in (select redditor from fx_users)"
    steps = {
        "posts": known,
        **_sentiment_steps("posts", "submission_id", "title", "s_"),
        **_entity_steps("posts", "submission_id", "title", "e_"),
        "scored": _scored("posts", "submission_id", "s_scores"),
        "dups": _dups("posts", "submission_id", "author", "title", "url"),
    }
    body = f"""
      select submission_id as "Submission ID", author as "Author", title as "Title", submission_score as "Score",
        url as "URL", shown as "Sentiment", coalesce(brackets, '') as "Named Entities",
        {_ratio('t')} as "Lexical Diversity", {_bigrams('t')} as "Common Bigrams", dup as "Is Duplicate"
      from posts join scored on scored.id = submission_id join dups on dups.id = submission_id
        join e_toks on e_toks.id = submission_id left join e_ents on e_ents.id = submission_id"""
    return _sql(body, "users", "submissions", "lexicon", "gazetteer", **steps)


def _sentiment_query(table: str, key: str, text: str) -> str:
    steps = _sentiment_steps(f"fx_{table}", key, text, "s_")
    body = f"select id as {key}, c as compound, shown as sentiment from scored"
    return _sql(body, table, "lexicon", **steps, scored=_scored(f"fx_{table}", key, "s_scores"))


def _scanned_query() -> str:
    """Of overlapping runs of words those that a scan from the left takes."""
    steps = _entity_steps("fx_comments", "comment_id", "body", "e_") | {
        "fx_gazetteer": f"""
            select distinct array_to_string(t[i:i + 1 + i % 2], ' ') as phrase, 'RUN' as label
            from (select t, unnest(range(1, len(t))) as i from (select {_tokens('text')} as t from benchmark))""",
        "e_scanned": """
            select id, list_reduce(list({'s': pos, 'e': pos + len, 'w': [phrase]} order by pos),
              lambda a, m: case when m.s >= a.e then {'s': m.s, 'e': m.e, 'w': a.w || m.w} else a end) as r
            from e_longest group by id""",
    }
    for unused in ("e_kept", "e_ents"):
        del steps[unused]
    steps = {"fx_gazetteer": steps.pop("fx_gazetteer"), **steps}
    body = """select comment_id, coalesce(array_to_string(r.w, ', '), '') as named_entities
      from fx_comments left join e_scanned on id = comment_id"""
    return _sql(body, "comments", **steps)


def _entity_query(table: str, key: str, text: str, shown: str) -> str:
    body = f"select {key}, coalesce({shown}, '') as named_entities from fx_{table} left join e_ents on id = {key}"
    return _sql(body, table, "gazetteer", **_entity_steps(f"fx_{table}", key, text, "e_"))


def _upsert_users() -> str:
    columns = "* exclude (k)"
    return _sql(
        f"""select {columns} from fx where k % 2 = 0 and k % 3 <> 0
        union all select {columns} replace (total_karma + 10 as total_karma) from fx where k % 2 = 1 and k % 3 <> 0
        union all select {columns} replace (total_karma + 20 as total_karma) from fx where k % 3 = 0""",
        "users", fx=f"select *, {_NUMBER} as k from fx_users",
    )


_SHAPES = """
  select {key}, array_to_string(list_filter(list_transform(string_split(array_to_string(list_transform(
      range(1, len(t) + 1), lambda i: case when i > 1 and t[i - 1] not in ('.', '!', '?') and regexp_matches(t[i], '^\\p{{Lu}}')
        then t[i] else chr(10) end), ' '), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ', ') as named_entities
  from (select {key}, {text} as t from fx_{table})"""

_PLUGGED = f"""
  select comment_id, array_to_string(ws, ', ') as named_entities from (
    select comment_id, list_filter({_pieces('body')}, lambda x: regexp_matches(x, '[0-9]')) as ws from fx_comments
  )"""

_USER_COLUMNS = """redditor_id as "User ID", redditor as "Username", created_utc as "Account Created",
  link_karma as "Link Karma", comment_karma as "Comment Karma", total_karma as "Total Karma",
  is_employee as "Is Employee", is_gold as "Is Gold", dormant_days as "Dormant Days",
  has_verified_email as "Has Verified Email", accepts_followers as "Accepts Followers",
  redditor_is_subscriber as "Is Subscriber" """

_LISTED = """select *, right(submission_id, 1) as community from fx_submissions
  qualify row_number() over (partition by right(submission_id, 1) order by {by} desc, submission_id) <= 25"""

_SIGHTINGS = """
  select author as name, 'submission' as role, submission_created_utc as seq, submission_id as sighting from fx_submissions
  where author is not null
  union all select comment_author, 'comment', comment_created_utc, comment_id from fx_comments
  where comment_author is not null"""


def _versions() -> str:
    """The rows of each table after one load and after the same load once more."""
    return _sql(
        f"""select v as version, name, n from (values (2), (3)) as versions(v), (
          select 'users' as name, count(*) as n from fx_users where {_NUMBER} % 19 <> 0
          union all select 'submissions', count(*) from fx_comments where comment_author in (select redditor from fx_users)
          union all select 'comments', (select count(*) from fx_peoples where {_STORED}) + (select count(*) from landed where opens))""",
        "users", "comments", "peoples", landed=_LANDED_POSTS.format(number=_NUMBER),
    )


def _failing() -> str:
    """Measures of the comment report with a tagger's words; texts with a seventh length show the error."""
    stripped = _strip("body")
    steps = {
        **_sentiment_steps("fx_comments", "comment_id", stripped, "s_"),
        "scored": _scored("fx_comments", "comment_id", "s_scores"),
        "tagged": f"""select comment_id as id, length({stripped}) % 7 = 0 as failed, array_to_string(list_filter({_pieces('body')},
            lambda x: regexp_matches(x, '[0-9]')), ', ') as words, {_tokens(stripped)} as t, {_clean_tokens('body')} as ct from fx_comments""",
        "ld": f"select id, failed, words, {_bigrams('t')} as bigrams, {_ratio('ct')} as r, len(ct) as n from tagged",
    }
    return _sql(
        f"""select ld.id as comment_id, case when failed then 'Error' else shown end as sentiment,
          case when failed then '' else words end as named_entities,
          case when failed then 'Error' else printf('%.2f', r) || ' (' || {_DIVERSITY} || ')' end as lexical_diversity,
          case when failed then '' else bigrams end as common_bigrams
        from ld join scored on scored.id = ld.id""",
        "comments", "lexicon", **steps,
    )


# Words by their pieces between whitespace, and the score of those that end in a period somewhere.
_ABBREVIATIONS = {
    "cut": f"""select comment_id, body, regexp_split_to_array(body, '[{_WS}]') as ps, regexp_extract_all(body, '[{_WS}]') as gaps,
      len(regexp_split_to_array(regexp_replace(body, '[{_WS}]+\\z', ''), '[{_WS}]')) as last from fx_comments""",
    "cores": """select *, regexp_replace(lower(p), '\\A[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}.]+\\z', '', 'g') as core
      from (select comment_id, body, gaps, last, unnest(ps) as p, generate_subscripts(ps, 1) as i from cut)""",
    "each": "select *, regexp_replace(core, '\\.+\\z', '') as word from cores",
    "counts": """select word, count(*) as n, count(*) filter (regexp_matches(core, '[\\p{L}\\p{N}]\\.\\z')) as stopped
      from each where regexp_matches(word, '\\p{L}') group by word""",
    "sized": """select *, length(replace(word, '.', '')) as size, sum(stopped) over () / sum(n) over () as share from counts""",
    "scored": """select word, n, stopped,
      -2 * (stopped * ln(share) + case when n > stopped then (n - stopped) * ln(1 - share) else 0 end
        - stopped * ln(0.99::double) - case when n > stopped then (n - stopped) * ln(1 - 0.99::double) else 0 end)
      * exp(-size) * (length(word) - size + 1) * pow(size::double, (stopped - n)::double) as score
      from sized where stopped > 0""",
}


def build() -> dict[str, str]:
    toks, body_toks = _tokens("title"), _tokens("body")
    words = _sentiment_steps("fx_comments", "comment_id", "body", "s_")["s_texts"]
    return {
        "comments_scan": _sql("select * from fx_comments", "comments"),
        "users_scan": _sql("select * from fx_users", "users"),
        "submissions_join": _sql(
            "select s.* from fx_submissions s join fx_users u on s.author = u.redditor", "submissions", "users"
        ),
        "submissions_by_author": _sql("select * from fx_submissions where author = 'Customer#000000007'", "submissions"),
        "comments_by_link": _sql("select * from fx_comments where link_id = 'p7'", "comments"),
        "communities_appended": _sql(
            """select *, 'news' as community from fx_submissions
            union all select *, 'nsfw' from fx_submissions where over_18""", "submissions",
        ),
        "communities_landed": _sql(
            """select * from fx_submissions
            union all select * from fx_submissions where over_18""", "submissions",
        ),
        "landing_comments": _sql(f"select {_COMMENT_COLUMNS} from fx_peoples", "peoples"),
        "landing_objects": _sql(
            """select comment_id as key, 1::bigint as n, body, case when edited_raw = '1700000000.0' then '1.7E9' else edited_raw end as edited
            from fx_comments_raw
            union all select 'none', count(*), null, null from fx_comments_raw where substring(comment_id, 2)::int % 4 in (1, 3)
            union all select 'empty', count(*), null, null from fx_comments_raw where substring(comment_id, 2)::int % 4 in (1, 2)""",
            "comments_raw",
        ),
        "landing_users": _sql(
            """select redditor_id, redditor, created_utc, link_karma, comment_karma, total_karma, is_employee, is_mod,
              is_gold, dormant_days, has_verified_email, accepts_followers, redditor_is_subscriber
            from landed where k % 19 <> 0 and k % 31 <> 0 and k % 37 <> 0 and k % 41 <> 0 and not (is_mod and k % 26 = 0)""",
            "users", landed=_LANDED,
        ),
        "landing_users_rejected": _sql(
            """select case when k % 31 = 0 then 'Deleted' else redditor end as redditorname, total_karma::double as total_karma
            from landed where k % 19 = 0""", "users", landed=_LANDED,
        ),
        "landing_submissions": _sql(
            "select * replace (coalesce(author, 'Deleted') as author) from fx_submissions", "submissions"
        ),
        "submissions_latest": _sql(
            """select * from (select * replace (replace(submission_id, 'r', 'p') as submission_id) from fx_submissions)
            qualify row_number() over (partition by submission_id order by submission_created_utc desc) = 1""", "submissions",
        ),
        "users_latest": _sql(
            """select * from sightings qualify row_number() over (partition by name
              order by role = 'submission' desc, case when role = 'submission' then -seq else seq end) = 1""",
            "submissions", "comments", sightings=_SIGHTINGS,
        ),
        "upsert_users": _upsert_users(),
        "upsert_submissions": _sql(
            """select * from (
              select * from fx_submissions where submission_id like 'p%'
                and replace(submission_id, 'p', 'r') not in (select submission_id from fx_submissions)
              union all select * replace (replace(submission_id, 'r', 'p') as submission_id)
                from fx_submissions where submission_id like 'r%')""", "submissions",
        ),
        "upsert_comments": _sql(
            f"""select * from fx_peoples
            where {_STORED} or comment_author in (select redditor from fx_users)""", "peoples", "users",
        ),
        "upsert_incremental": _sql(
            f"""select * from fx_peoples
            where {_STORED} or comment_author in (select redditor from fx_users)""", "peoples", "users",
        ),
        "version_before": _sql(f"select * from fx_peoples where {_STORED}", "peoples"),
        "load_versions": _versions(),
        "name_clashes": _sql(
            "select author, count(*) as n from fx_submissions where author is not null group by author having count(*) > 1",
            "submissions",
        ),
        "submissions_known_row": _sql(
            "select * from fx_submissions where author in (select redditor from fx_users)", "submissions", "users"
        ),
        "submissions_known_group": _sql(
            """select * from fx_submissions where exists (select 1 from fx_submissions s
              join fx_users u on s.author = u.redditor)""", "submissions", "users",
        ),
        "comments_known_row": _sql(f"select comment_id, comment_author, link_id from ({_NEW_OPENING})", "peoples", "users"),
        "comments_known_group": _sql(
            f"""select comment_id, comment_author, link_id from fx_peoples
            where link_id in (select link_id from ({_NEW_OPENING}))""", "peoples", "users",
        ),
        "comments_new": _sql(f"select comment_id, comment_author from fx_peoples where not {_STORED}", "peoples"),
        "dup_comments": _sql(
            f"select id as comment_id, case when dup then 'Yes' else 'No' end as is_duplicate from ({_dups('fx_comments', 'comment_id', 'body')})",
            "comments",
        ),
        "dup_submissions": _sql(
            f"select id as submission_id, dup as is_duplicate from ({_dups('fx_submissions', 'submission_id', 'author', 'title', 'url')})",
            "submissions",
        ),
        "distinct_bodies": _sql(f"select distinct {_strip('body')} as text from fx_comments where body <> ''", "comments"),
        "cleaned_bodies": _sql(
            f"select comment_id, array_to_string({_pieces(_words_only('body'))}, ' ') as cleaned from fx_comments", "comments"
        ),
        "title_tokens": _sql(f"select submission_id, array_to_string({toks}, chr(10)) as tokens from fx_submissions", "submissions"),
        "body_tokens": _sql(
            f"""select comment_id, len(t) as n_tokens, md5(array_to_string(t, chr(10))) as tokens_md5
            from (select comment_id, {body_toks} as t from fx_comments)""", "comments",
        ),
        "abbreviations": _sql(
            "select word, n, stopped, round(score, 6) as score, score >= 0.3 as abbreviation from scored", "comments", **_ABBREVIATIONS
        ),
        "kept_tokens": _sql(
            f"""select comment_id, len(t) as n_tokens, md5(array_to_string(t, chr(10))) as tokens_md5
            from (select comment_id, list_transform({_tokens('safe')}, lambda x: replace(x, chr(64976), '.')) as t from (
              select comment_id, case when body is not null then coalesce(string_agg(case when i < last and ends_with(p, '.')
                  and regexp_matches(core, '[\\p{{L}}\\p{{N}}]\\.\\z')
                  and word in (select word from scored where score >= {P.ABBREVIATION})
                then p[:-2] || chr(64976) else p end || coalesce(gaps[i], ''), '' order by i), '') end as safe
              from each group by comment_id, body))""", "comments", **_ABBREVIATIONS,
        ),
        "sentiment_word_lists": _sql(
            f"select id as comment_id, md5(array_to_string(ws, chr(10))) as words_md5 from ({words})", "comments"
        ),
        "lexdiv_comments": _sql(
            f"""select comment_id, r as score, printf('%.2f', r) || ' (' || {_DIVERSITY} || ')' as lexical_diversity
            from (select comment_id, {_ratio('ct')} as r, len(ct) as n
              from (select comment_id, {_clean_tokens('body')} as ct from fx_comments))""", "comments",
        ),
        "lexdiv_titles": _sql(
            f"select submission_id, {_ratio('t')} as lexical_diversity from (select submission_id, {toks} as t from fx_submissions)",
            "submissions",
        ),
        "bigrams": _sql(
            f"select comment_id, {_bigrams('t')} as common_bigrams from (select comment_id, {body_toks} as t from fx_comments)",
            "comments",
        ),
        "sentiment_comments": _sentiment_query("comments", "comment_id", "body"),
        "sentiment_titles": _sentiment_query("submissions", "submission_id", "title"),
        "entities_comments": _entity_query("comments", "comment_id", "body", "words"),
        "entities_titles": _entity_query("submissions", "submission_id", "title", "brackets"),
        "entities_scanned": _scanned_query(),
        "entity_shapes": _sql(_SHAPES.format(key="submission_id", text=_tokens("title"), table="submissions"), "submissions"),
        "entity_shapes_comments": _sql(_SHAPES.format(key="comment_id", text=_tokens("body"), table="comments"), "comments"),
        "entities_plugged": _sql(_PLUGGED, "comments"),
        "failing_texts": _failing(),
        "newest_per_user": _sql(_NEWEST, "activity"),
        "activity_of_users": _sql("select * from fx_activity where redditor in (select redditor from fx_users)", "activity", "users"),
        "activity_log": _sql(
            """select comment_author as redditor, comment_created_utc as created_utc, 'comment' as kind, comment_id as item_id
            from fx_comments union all
            select author, submission_created_utc, 'submission', submission_id from fx_submissions""", "comments", "submissions",
        ),
        "top_submissions": _sql(_LISTED.format(by="submission_score"), "submissions"),
        "new_submissions": _sql(_LISTED.format(by="submission_created_utc"), "submissions"),
        "first_activity": _sql(_FIRST, "activity"),
        "first_harvested_activity": _sql(
            f"select redditor, min(created_utc) as first_activity from ({_NEWEST}) group by redditor", "activity"
        ),
        "dormancy": _sql(
            f"""select redditor_id, redditor, f as first_activity, floor((f - created_utc) / 86400.0)::int as dormant_days
            from (select u.*, coalesce(first_activity, {P.AS_OF})::bigint as f from fx_users u left join ({_FIRST}) using (redditor))""",
            "users", "activity",
        ),
        "account_age": _sql(f"select redditor_id, {_AGE} as account_age from fx_users", "users"),
        "low_karma": _sql(f"select redditor_id, {_LOW} as low_karma from fx_users", "users"),
        "young_accounts": _sql(f"select redditor_id, {_YOUNG} as young_account from fx_users", "users"),
        "account_flags": _sql(
            f"""select redditor_id, concat_ws('|', case when {_LOW} then 'Low Karma' end,
              case when {_YOUNG} then 'Young Account Age' end) as flags from fx_users""", "users",
        ),
        "bursts": _sql(_BURSTS, "activity"),
        "stream_bursts": _sql(
            _BURSTS.replace(
                "and n >= 2", f"and n >= 2 and created_utc + {BURST_DAYS * DAY} <= (select max(created_utc) - {DAY} from fx_activity)"
            ).replace("select redditor, created_utc - lag", "select redditor, created_utc, created_utc - lag"), "activity",
        ),
        "stream_comments": _sql("select * from fx_comments", "comments"),
        "comment_report": _comment_report(),
        "comment_report_per_text": _comment_report(),
        "submission_report": _submission_report(),
        "user_report": _sql(
            f"""select {_USER_COLUMNS}, {_AGE} as "Account Age", {_LOW} as "Low Karma", {_YOUNG} as "Young Account",
              redditor in (select redditor from ({_BURSTS})) as "Burst Activity" from fx_users""", "users", "activity",
        ),
        "user_bursts": _sql(
            f"""select redditor_id, burst_count is not null as burst_activity, coalesce(burst_count, 0) as burst_count,
              coalesce(max_burst_size, 0) as max_burst_size from fx_users left join ({_BURSTS}) using (redditor)""", "users", "activity",
        ),
        "submissions_as_lines": _sql("select * from fx_submissions", "submissions"),
        "submissions_as_object": _sql("select * from fx_submissions", "submissions"),
        "landing_any_layout": _sql("select comment_id, comment_author, body, link_id from fx_comments_raw", "comments_raw"),
        "landing_rejects": _sql(
            """select reason, count(*) as n from (
              select case substring(comment_id, 2)::int % 7 when 0 then 'malformed' when 1 then 'not an object' when 2 then 'not an object' end as reason
              from fx_comments_raw) where reason is not null group by reason""", "comments_raw",
        ),
        "ingest_row": _ingested("row"),
        "ingest_group": _ingested("group"),
        "ingest_users": _sql(
            """select redditor_id, redditor, created_utc, link_karma, comment_karma, total_karma, is_employee, is_mod,
              is_gold, dormant_days, has_verified_email, accepts_followers, redditor_is_subscriber
            from landed where k % 19 <> 0""", "users", landed=_LANDED,
        ),
        "load_counted": _sql(
            """select redditor_id, redditor, created_utc, link_karma, comment_karma, total_karma, is_employee, is_mod,
              is_gold, dormant_days, has_verified_email, accepts_followers, redditor_is_subscriber
            from landed where k % 19 <> 0""", "users", landed=_LANDED,
        ),
        "ingest_submissions": _sql(
            f"""select 's' || k as submission_id, comment_author as author, null::varchar as title, null::int as submission_score
            from (select {_K} as k, comment_author from fx_comments) where comment_author in (select redditor from fx_users)""",
            "comments", "users",
        ),
        "load_counts": _load_counts(),
        "load_counters": _load_counts(),
        "cleared_comments": _sql("select * from fx_comments", "comments"),
    }


def _ingested(gate: str) -> str:
    """Stored comments and the admitted ones; the group gate lets the unknown user's in as well."""
    columns = "comment_created_utc, last_body as body, comment_score, is_submitter, edited, link_id"
    other = f"union all select 'd' || k, 'ghost_0', {columns} from landed where opens"
    return _sql(
        f"""select {_COMMENT_COLUMNS} from fx_peoples where {_STORED}
        union all select comment_id, comment_author, {columns} from landed where opens
        {other if gate == 'group' else ''}""",
        "users", "comments", "peoples", landed=_LANDED_POSTS.format(number=_NUMBER),
    )


def _load_counts() -> str:
    return _sql(
        f"""select 'users found' as what, count(*) as n from landed
        union all select 'users accepted', count(*) from landed where k % 19 <> 0
        union all select 'submissions found', count(*) from posts
        union all select 'comments kept', sum(1 + ({_BY_PEOPLE})::int)::bigint from posts
        union all select 'records rejected', (select count(*) from twice) - (select count(*) from posts)""",
        "users", "comments", landed=_LANDED,
        twice=f"select *, {_K} as k from fx_comments union all select *, {_K} as k from fx_comments where {_K} % 10 = 0",
        posts="select * from twice where k % 100 <> 1",
    )
