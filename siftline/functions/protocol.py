"""Texts of the scoring protocol: prompt parts, answer keys, messages."""

from __future__ import annotations

from dataclasses import dataclass

# Keys an answer block may use.
ANSWER_KEYS = [
    "JOB_ID", "STATUS", "REASON", "REASONING", "SCORE", "REQS_MATCH", "DOMAIN_MATCH",
    "GAPS", "HARD_REQUIREMENTS", "PREFERRED_REQUIREMENTS", "ADDRESS",
]
# Defaults of a scored answer.
DEFAULT_GAPS = "No significant gaps identified"
DEFAULT_LIST = "None listed"
# Fixed value: separator between listings of a prompt.
BLOCK_SEPARATOR = "\n\n---\n\n"
# Lead-in of a later prompt.
CONTINUATION = "Here are more listings. What was said at the start about the candidate and the answer form still holds.\n\n"
# Failure reasons.
MISSING_FIELD = "Missing required field '%s' in block:\n%s"
MISSING_FIELD_OF = "Missing required field '%s' in %s block:\n%s"
BAD_INTEGER = "invalid literal for int() with base 10: '%s'"
UNKNOWN_STATUS = "Unknown STATUS '%s' in block:\n%s"
MISSING_RESULTS = "Missing results for job IDs: [%s]"
MISSING_FROM_WORKER = "Result missing from worker"


@dataclass(frozen=True)
class Profile:
    """What the scorer is told about the candidate."""

    background: str = ""
    rules: str = ""
    fit_criteria: str = ""
    request_address: bool = False


def prompt_head(profile: Profile) -> str:
    return (
        "Judge how well each job listing below fits one candidate. A listing either breaks one of "
        "the rules and is filtered out, or it gets a score.\n\n"
        f"## Candidate background\n\n{profile.background}\n\n"
        "## Rules (hard filters)\n\n"
        "Check the rules before anything else. Never score a listing that breaks a rule.\n\n"
        f"{profile.rules}\n\n"
        "## Fit criteria (scoring instructions)\n\n"
        "Score the remaining listings. Weigh the match with the stated requirements and the match "
        "with the company's domain.\n\n"
        f"{profile.fit_criteria}\n\n"
        "## Jobs to evaluate\n\n"
    )


def prompt_tail(profile: Profile) -> str:
    address = (
        "\nADDRESS: <street address of the workplace; write null if the job is remote or you are not sure>"
        if profile.request_address
        else ""
    )
    return (
        "\n\n## Response format\n\n"
        "Answer with one block per job, in the given order, under the job's own number (0 is a valid "
        "number). Put an empty line between blocks and write nothing else. A later block for the same "
        "number replaces the earlier one.\n\n"
        "A filtered job:\n```\n"
        "JOB_ID: <number>\nSTATUS: FILTERED\nREASON: <one sentence: the rule that was broken>\n```\n\n"
        "A scored job:\n```\n"
        "JOB_ID: <number>\nSTATUS: SCORED\nSCORE: <integer 0-100>\n"
        "REQS_MATCH: <integer 0-100>\nDOMAIN_MATCH: <integer 0-100>\n"
        "REASONING: <2-6 sentences>\n"
        f'GAPS: <1-2 sentences, or "{DEFAULT_GAPS}">\n'
        f'HARD_REQUIREMENTS: <items separated by " | ", or "{DEFAULT_LIST}">\n'
        f'PREFERRED_REQUIREMENTS: <items separated by " | ", or "{DEFAULT_LIST}">'
        f"{address}\n```\n"
    )
