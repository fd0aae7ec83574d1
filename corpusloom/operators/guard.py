"""Citation guard, claim ledger and evidence gate: joins of answers, claims and retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import claim_tokens, strict_normal
from corpusloom.operators.retrieve import top_k

SUPPORT, LEAST_TOKENS, RARE_HITS, RARE_CLAIM, RARE_LENGTH = 0.15, 6, 3, 12, 8
#: How an answer lists sources, how tools say that they found nothing or something, how claims, identifiers and numbers look.
SOURCES = r"(?imd)^[#>\*\s-]*sources?\b[^a-z]*$"
EMPTY_MARKERS = ("NO_RELEVANT_CHUNKS", "NO_PARENT_DOCUMENT", "NO_PARENT_DOCUMENTS", "EMBEDDING_ERROR", "RETRIEVAL_ERROR", "PARENT_RETRIEVAL_ERROR")
RESULT_BLOCK = "--- RESULT|--- PARENT"
LEAST_QUERY = 8
CLAIM_ID, CLAIM_REF = r"^[A-Za-z0-9_.-]{1,32}$", r"\[\[claim:([A-Za-z0-9_.-]+)\]\]"
PMID, DOI = r"^[0-9]{6,9}$", r"(?i)^10\.[0-9]{4,9}/\S+$"
NUMBER, FOLD = r"[0-9]+(?:\.[0-9]+)?", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*-?\s*(?:fold|×|x)\b"
INLINE_MARK = r"\((?:see\s+)?[A-Z][\w'\-]+(?:\s+et\s+al\.)?(?:\s*(?:,|&|and)\s*[A-Z][\w'\-]+)*,?\s*[0-9]{4}[a-z]?\)"
STEM = r"^([A-Za-z][\w'\-]*?)[ _\-]+((?:19|20)[0-9]{2})(?=[ _\-]|\b)"
CONFIDENCES = ("strong", "moderate", "weak")
RETRIEVAL_TOOLS = ("search_child_chunks", "retrieve_parent_chunks", "retrieve_many_parents")
NO_PARENTS = ("unknown", "N/A", "none")
NO_EVIDENCE = "**Evidence coverage:** No retrieval in this session returned usable results — there is no literature supporting the question in this knowledge base; the answer below reflects only weak/partial signals; treat it as ungrounded."
NOT_VISIBLE = "**Evidence coverage:** Retrieval ran but no results are visible in the current context (compressed); grounding could not be re-verified."
#: The heading of an answer's sources and what stands before the claims that nothing verifies; a year in a title.
SOURCES_MARK = "**Sources:**"
UNVERIFIED = "⚠ Unverified claims"
EVIDENCE_YEAR = r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b"
CLAIM_SHOWN = 120


def weight(token: Column) -> Column:
    return F.when(F.length(token) >= RARE_LENGTH, 3).otherwise(1)


def lexical_support(pairs: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, chunk_id, score, supported of pairs; claims and chunks: id, tokens. A caller that has costly tokens stages them once: they are read twice.

    A claim's tokens count as often as they occur, long ones threefold; a chunk has a token or not. Short claims and empty
    chunks pass with 1.0.
    """
    claim = claims.select("claim_id", F.posexplode("tokens").alias("i", "t")).withColumn("w", weight(F.col("t")))
    total = claim.groupBy("claim_id").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    has = chunks.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("t"))
    hit = pairs.join(claim, "claim_id").join(has, ["chunk_id", "t"]).groupBy("claim_id", "chunk_id").agg(F.sum("w").alias("hit"), F.count_distinct(F.when(F.col("w") == 3, F.col("t"))).alias("rare"))
    out = pairs.join(total, "claim_id", "left").join(hit, ["claim_id", "chunk_id"], "left").join(chunks.select("chunk_id", F.size("tokens").alias("m")), "chunk_id", "left")
    free = (F.coalesce("n", F.lit(0)) < LEAST_TOKENS) | (F.coalesce("m", F.lit(0)) <= 0)
    score = F.when(free, 1.0).otherwise(F.coalesce("hit", F.lit(0)) / F.col("total"))
    return out.select("claim_id", "chunk_id", score.alias("score"), (free | ((score >= SUPPORT) & ((F.coalesce("rare", F.lit(0)) >= RARE_HITS) | (F.col("n") < RARE_CLAIM)))).alias("supported"))


def split_sources(answer: Column) -> tuple[Column, Column]:
    """The body, and the lines below the last Sources header without their bullets."""
    parts, heads = F.split(answer, SOURCES), F.regexp_extract_all(answer, F.lit(SOURCES), F.lit(0))
    many = F.size(parts) > 1
    before = F.substring(answer, F.lit(1), F.length(answer) - F.length(F.element_at(parts, -1)) - F.length(F.element_at(heads, F.lit(-1))))
    body = F.when(many, F.regexp_replace(before, r"[\n-]+\z", "")).otherwise(answer)
    lines = F.when(many, F.transform(F.split(F.element_at(parts, -1), "\n"), lambda x: F.regexp_extract(x, r"^\s*(?:[-*•]|[0-9]+[.)])?\s*(.+?)\s*$", 1))).otherwise(F.array().cast("array<string>"))
    return body, F.filter(lines, lambda x: x != "")


def known_parents(keys: DataFrame, messages: DataFrame) -> DataFrame:
    """session, parent_id: what a session retrieved, by its keys (session, key) 'parent::<id>' and the 'Parent ID: <id>' lines of its retrieval
    messages (session, name, text)."""
    own = keys.filter(F.col("key").startswith("parent::") & (F.length("key") > 8)).select("session", F.substring("key", 9, 1 << 30).alias("parent_id"))
    shown = messages.filter(F.col("name").isin(*RETRIEVAL_TOOLS)).select("session", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)Parent ID:\s*(.+?)\s*$"), F.lit(1))).alias("p"))
    shown = shown.select("session", F.regexp_replace(F.trim("p"), r"^[*_]+|[*_]+$", "").alias("parent_id")).filter((F.col("parent_id") != "") & ~F.col("parent_id").isin(*NO_PARENTS))
    return own.unionByName(shown).distinct()


def resolve_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """session, pos, line, parent_id, how: the retrieved parent that a source line means, by the first of five ways: its id stands in the
    line, the line names its file, holds its long stem, gives it as Parent ID, or is much like its title; null if none does.

    lines: session, pos, line. known: session, parent_id, title. An id is source#section#hash. Lines meet the parents of their own session only; of
    several parents the least id counts.
    """
    source = F.element_at(F.split("parent_id", "#"), 1)
    # words are cut before lines and parents meet, once each
    parents = known.select("session", "parent_id", source.alias("src"), F.lower(F.regexp_replace(source, r"(?<=.)\.[^./]*$", "")).alias("stem"), F.array_distinct(claim_tokens(F.coalesce("title", F.lit("")))).alias("_b"))
    marked = known.groupBy("session").agg(F.max(F.col("parent_id").contains("#")).alias("full"))
    both = lines.select("session", "pos", "line", F.array_distinct(claim_tokens(F.col("line"))).alias("_a")).join(parents, "session").join(marked, "session")
    files = F.regexp_extract_all("line", F.lit(r"(?i)[\w\-.]+\.(?:md|pdf|txt|docx|doc)\b"), F.lit(0))
    stems = F.transform(files, lambda f: F.lower(F.regexp_replace(f, r"(?<=.)\.[^./]*$", "")))
    literal = F.col("line").contains(F.col("parent_id")) & F.when(F.col("full"), F.col("parent_id").contains("#")).otherwise(F.length("parent_id") >= 8)
    by_file, by_stem = F.array_position(files, F.col("src")), F.array_position(stems, F.col("stem"))
    hint = F.regexp_replace(F.trim(F.regexp_extract("line", r"(?m)Parent ID:\s*(\S.+?)\s*$", 1)), r"^[*_]+|[*_]+$", "")
    a, b = F.col("_a"), F.col("_b")
    alike = F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    # an exact file name comes before the stem of the same or a later one
    named = F.least(F.when(by_file > 0, 2 * by_file), F.when(by_stem > 0, 2 * by_stem + 1))
    how = F.when(literal, "id").when(named.isNotNull(), "file").when((F.length("stem") >= 8) & F.lower("line").contains(F.col("stem")), "stem").when(hint == F.col("parent_id"), "hint").when(alike >= 0.6, "title")
    order = F.array_position(F.array(*[F.lit(x) for x in ("id", "file", "stem", "hint", "title")]), F.col("how"))
    found = both.select("session", "pos", "parent_id", how.alias("how"), named.alias("_at"), F.round(alike, 9).alias("_like")).filter("how is not null")
    best = top_k(found, 1, ["session", "pos"], [order, F.when(F.col("how") == "file", F.col("_at")).otherwise(0), F.when(F.col("how") == "title", -F.col("_like")).otherwise(0.0), F.col("parent_id")])
    return lines.join(best.select("session", "pos", "parent_id", "how"), ["session", "pos"], "left")


def enforce_citations(answers: DataFrame, known: DataFrame, parents: DataFrame) -> DataFrame:
    """session, answer, kept, dropped, annotated: answers (session, text) with their Sources verified against what the session retrieved.

    Lines that mean no retrieved parent go. Lines whose parent isn't in the store (parents: parent_id, content) or shares no words with the
    body's long sentences (a support under 0.05 over the first twelve) are marked. known: session, parent_id, title.
    """
    body, lines = split_sources(F.col("text"))
    parsed = answers.select("session", "text", body.alias("body"), lines.alias("lines"), F.get(F.reverse(F.regexp_extract_all("text", F.lit(SOURCES), F.lit(0))), F.lit(0)).alias("header"))
    each = parsed.select("session", F.posexplode("lines").alias("pos", "line"))
    found = resolve_lines(each, known)
    texts = found.filter("parent_id is not null").join(parents.select("parent_id", F.col("content").alias("_c")), "parent_id", "left")
    sentences = F.slice(F.filter(F.split("body", r"(?<=[.!?])\s+"), lambda x: F.length(x) > 40), 1, 12)
    said = parsed.select("session", F.posexplode(sentences).alias("n", "claim"))
    claims = said.select(F.struct("session", "n").alias("claim_id"), claim_tokens(F.col("claim")).alias("tokens"))
    chunks = texts.filter("_c is not null").select("parent_id", "_c").distinct().select(F.col("parent_id").alias("chunk_id"), claim_tokens(F.col("_c")).alias("tokens"))
    pairs = texts.filter("_c is not null").select("session", F.col("parent_id").alias("chunk_id")).distinct().join(said.select("session", F.struct("session", "n").alias("claim_id")), "session").drop("session")
    scored = lexical_support(pairs, claims, chunks).groupBy(F.col("claim_id.session").alias("session"), F.col("chunk_id").alias("parent_id")).agg(F.max("score").alias("best"))
    judged = found.join(texts.select("session", "pos", F.col("_c").isNull().alias("lost")), ["session", "pos"], "left").join(scored, ["session", "parent_id"], "left")
    weak = F.when(F.col("lost"), F.lit("  ⚠️[unverified: parent store miss]")).when(F.col("best") < 0.05, F.concat(F.lit("  ⚠️[low lexical support: "), F.format_number("best", 2), F.lit("]")))
    marked = judged.select("session", "pos", F.when(F.col("parent_id").isNotNull(), F.concat("line", F.coalesce(weak, F.lit("")))).alias("line"), weak.isNotNull().alias("noted"))
    rows = marked.groupBy("session").agg(F.count("line").alias("kept"), (F.count("*") - F.count("line")).alias("dropped"), F.count_if(F.col("noted") & F.col("line").isNotNull()).alias("annotated"), F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))).alias("l"))
    out = parsed.join(rows, "session", "left").fillna(0, ["kept", "dropped", "annotated"])
    listed = F.concat(F.lit("\n\n"), F.rtrim(F.regexp_replace("header", r"\s+\z", "")), F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    note = F.when(F.col("dropped") > 0, F.concat(F.lit("\n\n<!-- citation_guard: "), F.col("dropped").cast("string"), F.lit(" source line(s) could not be matched to any retrieved parent chunk and were removed -->"))).otherwise("")
    answer = F.when(F.col("header").isNull(), F.col("text")).otherwise(F.concat(F.regexp_replace("body", r"\s+\z", ""), F.when(F.col("kept") > 0, listed).otherwise(""), note))
    return out.select("session", answer.alias("answer"), "kept", "dropped", "annotated")


def citation_scores(answers: DataFrame, known: DataFrame, parents: DataFrame) -> DataFrame:
    """session, n_source_lines, n_whitelisted, whitelist_rate, n_dropped, n_annotated, lexical_scores of answers (session, text), nothing rewritten.

    A line is whitelisted if it means a retrieved parent (known: session, parent_id, title). Of such lines whose parent has a text (parents: parent_id, content), and answers
    with a sentence of over 40 characters, the score is that of the first of twelve such sentences that the parent supports, else the best one; under 0.05 a line would be
    annotated. lexical_scores are in the order of lines. Without lines all counts are 0 and the rate is null.
    """
    body, lines = split_sources(F.coalesce("text", F.lit("")))
    parsed = answers.select("session", body.alias("body"), lines.alias("lines"))
    found = resolve_lines(parsed.select("session", F.posexplode("lines").alias("pos", "line")), known).select("session", "pos", "parent_id")
    sentences = F.slice(F.filter(F.split("body", r"(?<=[.!?])\s+"), lambda x: F.length(x) > 40), 1, 12)
    said = parsed.select("session", F.posexplode(sentences).alias("n", "claim"))
    claims = said.select(F.struct("session", "n").alias("claim_id"), claim_tokens(F.col("claim")).alias("tokens"))
    met = found.filter("parent_id is not null").select("session", "parent_id").distinct()
    # texts stay where they are; only their words meet the claims
    chunks = parents.filter(F.coalesce("content", F.lit("")) != "").join(met.select("parent_id").distinct(), "parent_id", "left_semi").select(F.col("parent_id").alias("chunk_id"), claim_tokens(F.col("content")).alias("tokens"))
    pairs = met.withColumnRenamed("parent_id", "chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_semi").join(said.select("session", F.struct("session", "n").alias("claim_id")), "session").drop("session")
    first = F.min_by("score", F.when(F.col("supported"), F.col("claim_id.n")))
    best = lexical_support(pairs, claims, chunks).groupBy(F.col("claim_id.session").alias("session"), F.col("chunk_id").alias("parent_id")).agg(F.coalesce(first, F.max("score")).alias("best"))
    scored = found.join(best, ["session", "parent_id"], "left").groupBy("session").agg(
        F.count("*").alias("n_source_lines"), F.count("parent_id").alias("n_whitelisted"), F.count_if(F.col("best") < 0.05).alias("n_annotated"),
        F.sort_array(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("pos", "best")))).alias("l"),
    )
    out = answers.select("session").join(scored, "session", "left").fillna(0, ["n_source_lines", "n_whitelisted", "n_annotated"])
    rate = F.when(F.col("n_source_lines") > 0, F.round(F.col("n_whitelisted") / F.col("n_source_lines"), 3))
    scores = F.coalesce(F.transform("l", lambda x: F.round(x["best"], 3)), F.array().cast("array<double>"))
    return out.select("session", "n_source_lines", "n_whitelisted", rate.alias("whitelist_rate"), (F.col("n_source_lines") - F.col("n_whitelisted")).alias("n_dropped"), "n_annotated", scores.alias("lexical_scores"))


def claims_from_sources(answers: DataFrame, most: int = 30) -> DataFrame:
    """session, claim_id, text, confidence, kind, doi, pmid, url, note: a weak claim for each of the first ``most`` source lines of an answer (session,
    text), citing the line's first DOI, else its first PMID, else the line itself, with the body's sentence around its [n] or [Sn]."""
    body, lines = split_sources(F.col("text"))
    rows = answers.select("session", body.alias("body"), F.posexplode(F.slice(lines, 1, most)).alias("i", "src")).withColumn("n", (F.col("i") + 1).cast("string"))
    some = lambda c: F.when(c != "", c)
    doi = some(F.regexp_replace(F.regexp_extract("src", r"(10\.[0-9]{4,9}/[^\s,;)]+)", 1), r"[.,;]+$", ""))
    pmid = F.when(doi.isNull(), some(F.regexp_extract("src", r"\b([0-9]{6,9})\b", 1)))
    at = F.array_min(F.filter(F.array(F.instr(F.col("body"), F.concat(F.lit("["), "n", F.lit("]"))), F.instr(F.col("body"), F.concat(F.lit("[S"), "n", F.lit("]")))), lambda p: p > 0))
    start = F.length(F.regexp_extract(F.substring("body", F.lit(1), F.col("at") - 1), r"^((?:.|\n)*\.)?", 1))
    rest = F.expr("substring(body, at, length(body))")
    mark = F.length(F.regexp_extract(rest, r"^(\[[^\]]*\])", 1))
    end = F.expr("locate('.', body, CAST(at + mark AS INT))")
    placed = rows.withColumn("at", at).withColumn("mark", mark).withColumn("lo", start).withColumn("hi", end)
    # without a full stop after the mark the last character is left out
    sentence = F.trim(F.expr("substring(body, lo + 1, CASE WHEN hi > 0 THEN hi - 1 - lo ELSE length(body) - 1 - lo END)"))
    around = F.expr("substring(body, greatest(1, at - 200), at + mark - greatest(1, at - 200))")
    note = F.when(F.col("at").isNotNull() & (doi.isNotNull() | pmid.isNotNull()), F.concat(F.lit("cited from body near: "), F.substring(F.coalesce(some(sentence), around), 1, 160)))
    return placed.select("session", F.concat(F.lit("S"), "n").alias("claim_id"), F.substring("src", 1, 300).alias("text"), F.lit("weak").alias("confidence"), F.lit("citation").alias("kind"), doi.alias("doi"), pmid.alias("pmid"), F.when(doi.isNull() & pmid.isNull(), F.substring("src", 1, 200)).alias("url"), note.alias("note"))


def claim_refs(answer: Column) -> Column:
    """Ids of the [[claim:...]] anchors of an answer, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(CLAIM_REF), F.lit(1))))


def tool_events(calls: DataFrame, results: DataFrame) -> DataFrame:
    """session, tool_use_id, name, type of an assistant's calls (session, tool_use_id, name): tool_error if a result (session, tool_use_id, is_error, text)
    failed or says ERROR in its first 200 characters, else tool_call."""
    failed = results.filter(F.coalesce("is_error", F.lit(False)) | F.upper(F.substring(F.coalesce("text", F.lit("")), 1, 200)).contains("ERROR"))
    failed = failed.select("session", F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), F.lit(True).alias("_f")).distinct()
    out = calls.select("session", F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), F.coalesce("name", F.lit("")).alias("name")).join(failed, ["session", "tool_use_id"], "left")
    return out.select("session", "tool_use_id", "name", F.when(F.col("_f"), "tool_error").otherwise("tool_call").alias("type"))


def claim_numbers(text: Column) -> Column:
    """Distinct numbers that a claim asserts, thousands separators removed; of a fold change its number."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))
    return F.array_sort(F.array_union(F.regexp_extract_all(t, F.lit(FOLD), F.lit(1)), F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))))


def numeric_mismatch(claim: Column, evidence: Column, years: Column | None = None) -> Column:
    """Whether no number of a claim stands in its evidence (an array of texts) or is a year of its sources, digits and points ending
    a number; null without numbers."""
    texts = F.transform(F.filter(evidence, lambda e: F.coalesce(e, F.lit("")) != ""), lambda e: F.replace(e, F.lit(","), F.lit("")))
    if years is not None:
        texts = F.concat(texts, F.transform(F.coalesce(years, F.array().cast("array<int>")), lambda y: y.cast("string")))
    # a number may stand before a point but not behind one: 4 in "4.5" counts, 5 doesn't
    stands = lambda n: F.exists(texts, lambda e: F.regexp_like(e, F.concat(F.lit(r"(?<![0-9.])"), F.replace(n, F.lit("."), F.lit(r"\.")), F.lit(r"(?![0-9])"))))
    mine = claim_numbers(claim)
    return F.when(F.size(mine) > 0, ~F.exists(mine, stands))


def standing_numbers(text: Column) -> Column:
    """The numbers that stand in a text, as numeric_mismatch looks for them: none that begins behind a digit or point, with and without what follows a point."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))
    return F.array_union(F.regexp_extract_all(t, F.lit(r"(?<![0-9.])[0-9]+"), F.lit(0)), F.regexp_extract_all(t, F.lit(r"(?<![0-9.])[0-9]+\.[0-9]+"), F.lit(0)))


def recheck_numbers(claims: DataFrame, evidence: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims with mismatch and their confidence weak, and evidence unresolved, where none of a claim's numbers stands in its evidence.

    claims: session, pos, text, confidence. evidence: session, pos, n, parent_id, note, title, verified, status. parents: parent_id, content. Numbers may stand in a parent, a
    note, or be the first year of a title. Claims also get n_verified, n_external and n_unresolved, counted afterwards; evidence gets reason. Texts never travel to
    claims: the numbers of each parent that some evidence names meet the claims' numbers by key.
    """
    at = ["session", "pos"]
    asked = claims.select(*at, F.explode(claim_numbers(F.col("text"))).alias("number"))
    named = evidence.filter(F.coalesce("parent_id", F.lit("")) != "").select(*at, "parent_id").distinct()
    told = parents.join(named.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", F.explode(standing_numbers(F.col("content"))).alias("number")).distinct()
    year = F.regexp_extract(F.coalesce("title", F.lit("")), EVIDENCE_YEAR, 1)
    beside = evidence.select(*at, F.explode(F.array_union(standing_numbers(F.col("note")), F.filter(F.array(year), lambda y: y != ""))).alias("number")).distinct()
    met = asked.join(named, at).join(told, ["parent_id", "number"]).select(*at).unionByName(asked.join(beside, [*at, "number"]).select(*at)).distinct()
    wrong = asked.select(*at).distinct().join(met, at, "left_anti").withColumn("_wrong", F.lit(True))
    bad = F.coalesce("_wrong", F.lit(False))
    after = evidence.join(wrong, at, "left").withColumn("verified", F.col("verified") & ~bad).withColumn("status", F.when(bad, "unresolved").otherwise(F.col("status"))).withColumn("reason", F.when(bad, "numeric-mismatch")).drop("_wrong")
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    counts = after.groupBy(*at).agg(n("verified"), n("external"), n("unresolved"))
    rows = claims.drop("n_verified", "n_external", "n_unresolved").join(wrong, at, "left").join(counts, at, "left").fillna(0, ["n_verified", "n_external", "n_unresolved"])
    return rows.withColumn("mismatch", bad).withColumn("confidence", F.when(bad, "weak").otherwise(F.col("confidence"))).drop("_wrong"), after


def surface_unverified(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """session, text, n_unverified: answers (session, text) that list, before their sources, the claims (session, pos, text, n_verified, n_unresolved) with unresolved and no
    verified evidence, in order and cut to CLAIM_SHOWN characters. An answer without a sources header stays as it is."""
    weak = claims.filter("n_verified = 0 and n_unresolved > 0").groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", F.substring("text", 1, CLAIM_SHOWN).alias("t")))).alias("_w"))
    rows = answers.join(weak, "session", "left")
    n = F.coalesce(F.size("_w"), F.lit(0))
    listed = F.array_join(F.transform("_w", lambda w: F.concat(F.lit("- "), F.coalesce(w["t"], F.lit("")))), "\n")
    block = F.concat(F.lit(f"\n\n{UNVERIFIED} ("), n.cast("string"), F.lit("):\n"), listed, F.lit("\n\n"))
    place = F.instr("text", SOURCES_MARK)
    put = F.concat(F.substring("text", F.lit(1), place - 1), block, F.substring(F.col("text"), place, F.length("text")))
    return rows.select("session", F.when((n > 0) & (place > 0), put).otherwise(F.col("text")).alias("text"), n.cast("long").alias("n_unverified"))


def evidence_status(kind: Column, verified: Column) -> Column:
    """verified, external or unresolved."""
    return F.when(verified, "verified").when(kind == "citation", "external").otherwise("unresolved")


def validate_evidence(evidence: DataFrame, keys: DataFrame, events: DataFrame, artifacts: DataFrame, strict: bool = True) -> DataFrame:
    """evidence with verified, status, error and warning.

    evidence: session, claim_id, n, kind, path, sha256, parent_id, tool_use_id, pmid, doi, url. A chunk's parent must stand in some key that its session
    retrieved (keys: session, key), a tool call in its trace without an error (events: session, tool_use_id, type), an artifact exist unchanged
    (artifacts: path, sha256); a citation needs a pmid, doi or url and is never verified here. What can't be found is an error if strict, else a warning.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = evidence.withColumn("kind", F.lower(F.coalesce("kind", F.lit(""))))
    for c in ("path", "parent_id", "tool_use_id"):
        rows = rows.withColumn(c, text(c))
    at = ["session", "claim_id", "n"]
    held = rows.filter((F.col("kind") == "chunk") & (F.col("parent_id") != "")).select(*at, "parent_id").join(keys, "session").filter(F.col("key").contains(F.col("parent_id")))
    rows = rows.join(held.select(*at).distinct().withColumn("_chunk", F.lit(True)), at, "left")
    calls = events.groupBy("session", "tool_use_id").agg(F.max(F.col("type") == "tool_error").alias("_failed"))
    rows = rows.join(calls, ["session", "tool_use_id"], "left").join(artifacts.select("path", F.col("sha256").alias("_sha")), "path", "left")
    kind, same = F.col("kind"), F.col("sha256").isNull() | (F.col("sha256") == "") | (F.col("sha256") == F.col("_sha"))
    missing = F.when(kind == "artifact", F.col("path") == "").when(kind == "chunk", F.col("parent_id") == "").when(kind == "tool_call", F.col("tool_use_id") == "").when(kind == "citation", (text("pmid") == "") & (text("doi") == "") & (text("url") == "")).otherwise(F.lit(False))
    soft = F.when(missing, F.lit(None)).when(kind == "artifact", F.when(F.col("_sha").isNull(), "artifact-missing").when(~same, "artifact-changed"))
    soft = soft.when(kind == "chunk", F.when(F.col("_chunk").isNull(), "chunk-not-retrieved")).when(kind == "tool_call", F.when(F.col("_failed").isNull(), "call-not-in-trace").when(F.col("_failed"), "call-failed"))
    hard = F.when(~kind.isin("artifact", "chunk", "tool_call", "citation"), "unknown-kind").when(missing, F.concat(kind, F.lit("-empty"))).when((kind == "citation") & (text("pmid") != "") & ~text("pmid").rlike(PMID), "pmid-malformed")
    doi = F.when((kind == "citation") & ~missing & (text("doi") != "") & ~text("doi").rlike(DOI), "doi-malformed")
    out = rows.withColumn("_soft", soft).withColumn("error", F.coalesce(hard, F.col("_soft") if strict else F.lit(None).cast("string"))).withColumn("warning", F.coalesce(doi, F.lit(None).cast("string") if strict else F.col("_soft")))
    verified = kind.isin("artifact", "chunk", "tool_call") & F.col("_soft").isNull() & F.col("error").isNull()
    return out.withColumn("verified", verified).withColumn("status", evidence_status(kind, F.col("verified"))).drop("_soft", "_chunk", "_failed", "_sha")


def validate_claims(claims: DataFrame, evidence: DataFrame, keys: DataFrame, events: DataFrame, artifacts: DataFrame, strict: bool = True) -> DataFrame:
    """session, pos, claim_id, confidence, kept, n_verified, n_external, n_unresolved, errors, warnings, one row a claim.

    claims: session, pos, claim_id, text, confidence. evidence as in validate_evidence, joined by session and pos (as claim_id). A claim needs an id of
    the right form that no earlier sound id of its session has, a text and evidence; an unknown confidence is a warning and becomes moderate. If strict, a
    claim whose evidence is all unresolved isn't kept.
    """
    judged = validate_evidence(evidence, keys, events, artifacts, strict)
    n = lambda s: F.count_if(F.col("status") == s)
    note = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lpad(F.col("n").cast("string"), 3, "0"), c))))
    counts = judged.groupBy("session", F.col("claim_id").alias("pos")).agg(n("verified").alias("n_verified"), n("external").alias("n_external"), n("unresolved").alias("n_unresolved"), note("error").alias("e"), note("warning").alias("w"))
    rows = claims.withColumn("claim_id", F.trim(F.coalesce("claim_id", F.lit("")))).withColumn("_good", F.col("claim_id").rlike(CLAIM_ID))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("session", "claim_id").orderBy("pos")))
    out = rows.join(counts, ["session", "pos"], "left").fillna(0, ["n_verified", "n_external", "n_unresolved"])
    said = F.lower(F.when(F.coalesce("confidence", F.lit("")) == "", "moderate").otherwise(F.col("confidence")))
    total, solid = F.col("n_verified") + F.col("n_external") + F.col("n_unresolved"), F.col("n_verified") + F.col("n_external")
    first = F.when(F.col("claim_id") == "", "id-missing").when(~F.col("_good"), "id-form").when(F.col("_nth") > 1, "id-repeated").when(F.trim(F.coalesce("text", F.lit(""))) == "", "text-missing")
    early = first.isNotNull()
    last = F.when(total == 0, "evidence-missing").when(F.lit(strict) & (solid == 0), "all-unresolved")
    none = F.array().cast("array<string>")
    errors = F.when(early, F.array(first)).otherwise(F.concat(F.coalesce("e", none), F.when(last.isNotNull(), F.array(last)).otherwise(none)))
    warnings = F.when(early, none).otherwise(F.concat(F.when(~said.isin(*CONFIDENCES), F.array(F.lit("confidence"))).otherwise(none), F.coalesce("w", none)))
    kept = ~early & last.isNull()
    return out.select("session", "pos", "claim_id", F.when(said.isin(*CONFIDENCES), said).otherwise("moderate").alias("confidence"), kept.alias("kept"), "n_verified", "n_external", "n_unresolved", errors.alias("errors"), warnings.alias("warnings"))


def evidence_gate(keys: DataFrame, messages: DataFrame) -> DataFrame:
    """session, queries, empty, blocks, no_evidence, note of a session's keys (session, key) and tool messages (session, text).

    Queries are the distinct 'search::' keys of eight characters or more. A message with a marker of EMPTY_MARKERS is empty, any other counts its result
    blocks. no_evidence: there were queries and empty messages, and no block. note is what an answer must carry then.
    """
    asked = keys.filter(F.col("key").startswith("search::")).select("session", F.trim(F.substring("key", 9, 1 << 30)).alias("q")).filter(F.length("q") >= LEAST_QUERY).groupBy("session").agg(F.count_distinct("q").alias("queries"))
    marked = F.col("text").rlike("|".join(EMPTY_MARKERS))
    told = messages.filter(F.coalesce("text", F.lit("")) != "").groupBy("session").agg(F.count_if(marked).alias("empty"), F.sum(F.when(marked, 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(RESULT_BLOCK), F.lit(0))))).alias("blocks"))
    out = asked.join(told, "session", "full_outer").fillna(0, ["queries", "empty", "blocks"])
    none = (F.col("queries") > 0) & (F.col("empty") > 0) & (F.col("blocks") == 0)
    note = F.when(none, F.lit(NO_EVIDENCE)).when((F.col("queries") > 0) & (F.col("blocks") == 0), F.lit(NOT_VISIBLE)).otherwise("")
    return out.select("session", "queries", "empty", "blocks", none.alias("no_evidence"), note.alias("note"))


def citable(known: DataFrame) -> DataFrame:
    """session, surname, year that a session's parents (session, parent_id, title) allow: from 'Surname_2020_...' at the start of the file's name, else '*' with a year
    in it; a year in a title is '*' too, which names no one."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("parent_id", "#"), 1), r"^.*/", ""), r"(?<=.)\.[^./]*$", "")
    rows = known.select("session", stem.alias("stem"), F.coalesce("title", F.lit("")).alias("title"))
    named, name, year = F.col("stem").rlike(STEM), F.regexp_extract("stem", STEM, 1), F.regexp_extract("stem", STEM, 2)
    bare = F.regexp_extract("stem", r"\b((?:19|20)[0-9]{2})\b", 1)
    own = rows.select("session", F.when(named, F.lower(name)).otherwise("*").alias("surname"), F.when(named, year).otherwise(bare).alias("year"))
    titled = rows.select("session", F.lit("*").alias("surname"), F.regexp_extract("title", r"\b((?:19|20)[0-9]{2})\b", 1).alias("year"))
    return own.unionByName(titled).filter("year <> ''").distinct()


def strip_unknown_citations(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """answers (session, text) without the (Author, year) marks of which no name stands with a year in allowed (session, surname, year), and n_removed.

    Marks without a year stay. The gaps that marks leave close. A session without any allowed pair keeps its answer as it is.
    """
    sets = allowed.groupBy("session").agg(F.collect_set(F.concat_ws(" ", "surname", "year")).alias("ok"))
    rows = answers.join(sets, "session", "left").withColumn("marks", F.regexp_extract_all("text", F.lit(INLINE_MARK), F.lit(0)))
    years = lambda m: F.regexp_extract_all(m, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    plain = lambda m: F.replace(F.replace(m, F.lit("et al"), F.lit(" ")), F.lit("see"), F.lit(" "))
    names = lambda m: F.filter(F.regexp_extract_all(F.lower(plain(m)), F.lit(r"[a-z][\w'\-]*"), F.lit(0)), lambda w: F.length(w) > 2)
    wanted = lambda m: F.flatten(F.transform(names(m), lambda w: F.transform(years(m), lambda y: F.concat_ws(" ", w, y))))
    rows = rows.withColumn("bad", F.filter("marks", lambda m: (F.size(years(strict_normal(m))) > 0) & ~F.coalesce(F.arrays_overlap(wanted(strict_normal(m)), F.col("ok")), F.lit(False))))
    cleaned = F.aggregate(F.array_distinct("bad"), F.col("text"), lambda t, m: F.replace(F.replace(t, F.concat(m, F.lit(" ")), F.lit(" ")), m, F.lit("")))
    closed = F.regexp_replace(F.regexp_replace(F.regexp_replace(cleaned, r"[ \t]{2,}", " "), r"\s+([,.;:])", "$1"), r"\s+—\s+", " — ")
    return rows.select("session", F.when(F.col("ok").isNull(), F.col("text")).otherwise(closed).alias("text"), F.when(F.col("ok").isNull(), 0).otherwise(F.size("bad")).cast("long").alias("n_removed"))


def tokens_of(df: DataFrame, key: str, name: str, text: str = "text") -> DataFrame:
    return df.select(F.col(key).alias(name), claim_tokens(F.col(text)).alias("tokens"))
