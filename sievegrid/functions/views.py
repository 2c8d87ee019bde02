"""What a selector is shown and told: headers, errors, and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .diffs import stripped, told

# Texts that a selector sees. They must equal the published ones for equal results.
TASK = (
    "\n\nIdentify the single commit from the candidate pool that fixes this vulnerability. Call list_candidates first, read promising commits with read_commit "
    "(drilling in with read_file_diff if needed), then call submit_answer with your final choice and a short reasoning."
)
REVIEW = (
    "# Your task\nCall list_candidates() to see the small review pool. Read EVERY candidate (each one matters). Compare them head-to-head, focusing on whether the diff actually "
    "addresses the CVE described above. Then call submit_answer ONCE — either confirming the primary's choice or overriding it."
)
STOP = "). The task is COMPLETE. STOP IMMEDIATELY — do not call any more tools, including submit_answer. Your conversation should now end."
NOT_A_RANK = " is out of range. commit_id should be a 12-char hex SHA from list_candidates, NOT a rank number."
NOT_FOUND = " candidate list. Pass the 12-char hex SHA from list_candidates (e.g. '3bf5eddb89af'), not a rank or partial guess."


def or_mark(text: Column, mark: str = "?") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(mark))


def commit_header(commit: Column, rank: Column, n: Column, author: Column, date: Column) -> Column:
    """Two lines above a commit's view; a commit that is no candidate has no rank."""
    place = F.when(rank.isNull(), F.lit("?")).otherwise(told("#", rank, " of ", n))
    return told("COMMIT ", F.left(commit, F.lit(12)), "  (Phase 1 rank ", place, ")\nAuthor: ", or_mark(author), "   Date: ", or_mark(date))


def commit_view(commit: Column, rank: Column, n: Column, author: Column, date: Column, body: Column) -> Column:
    """A commit's view under its header; null bodies are commits without content."""
    absent = told("[Error] Commit ", F.left(commit, F.lit(12)), " not found in repo2commits_diff.")
    return F.when(body.isNull(), absent).otherwise(told(commit_header(commit, rank, n, author, date), "\n\n", body))


def not_found(asked: Column, n: Column) -> Column:
    """What a name that no candidate has is answered with."""
    digits = F.trim(F.regexp_replace(F.trim(asked), "^#+", ""))
    number = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("long"))
    inside = told("[Error] Could not interpret '", asked, "'. To read rank ", number, ", pass the SHA from list_candidates.")
    outside = told("[Error] '", asked, "' looks like a rank number, but ", n, " candidates available and ", number, NOT_A_RANK)
    other = told("[Error] commit_id '", asked, "' not found in the Top-", n, NOT_FOUND)
    return F.when(number.between(1, n), inside).when(number.isNotNull(), outside).otherwise(other)


def file_not_found(path: Column, commit: Column, files: Column) -> Column:
    return told("[Error] File `", path, "` not found in commit ", F.left(commit, F.lit(12)), ". Available files: ", F.array_join(F.slice(F.transform(files, lambda f: f["path"]), 1, 10), ", "))


def after_submission(answer: Column) -> Column:
    return told("[Error] You have already submitted your answer (", F.left(answer, F.lit(12)), STOP)


def _case(query: Column, owner: Column, repo: Column, description: Column) -> Column:
    text = F.coalesce(F.nullif(stripped(F.coalesce(description, F.lit(""))), F.lit("")), F.lit("(no description provided)"))
    return told("CVE ID: ", query, "\nRepository: ", owner, "/", repo, "\n\nCVE Description:\n", text)


def selection_prompt(query: Column, owner: Column, repo: Column, description: Column) -> Column:
    return told(_case(query, owner, repo, description), TASK)


def review_prompt(query: Column, owner: Column, repo: Column, description: Column, pick: Column, reasoning: Column) -> Column:
    """What a reviewer of a first pass's pick is told."""
    chosen = F.coalesce(F.nullif(F.left(pick, F.lit(12)), F.lit("")), F.lit("<none>"))
    return told(_case(query, owner, repo, description), "\n\n# Primary agent's choice\ncommit_id: ", chosen, "\nreasoning: ", F.coalesce(reasoning, F.lit("")), f"\n\n{REVIEW}")


def numbered(views: Column) -> Column:
    """[1] to [n] before views, blank lines between."""
    return F.array_join(F.transform(views, lambda v, i: told("[", i + 1, "] ", v)), "\n\n")


def chain_prompt(instruction: str, example: str, shown: Column, description: Column, ask: str = "") -> Column:
    """Instruction and example, what is shown, the description, and where the model goes on."""
    return told(f"{instruction}\n\n{example}\n", shown, ask, "\n\nCVE: ", description, "\nThought:")
