"""How a vault is laid out. Fixed values."""

#: The index note of each top folder.
INDEX_NOTES = {
    "01-Daily": "01-Daily/Daily-MOC.md",
    "20-Projects": "20-Projects/Projects-MOC.md",
    "30-Agents": "30-Agents/Agents-MOC.md",
    "40-Systems": "40-Systems/Systems-MOC.md",
    "50-Configs": "50-Configs/Configs-MOC.md",
    "60-Scripts": "60-Scripts/Scripts-MOC.md",
    "90-Reference": "90-Reference/Reference-MOC.md",
}
#: Decision records have an index of their own below their folder's.
RECORDS, RECORDS_INDEX = "40-Systems/ADRs/", "40-Systems/ADRs/ADRs-MOC.md"
#: Notes at the top that need no link to them, in lower case.
ANCHORS = ["index.md", "operator.md", "agents.md", "readme.md"]
#: Files kept as they are.
RAW_ENDINGS = [".conf", ".yaml", ".yml", ".json", ".toml", ".sh", ".py", ".sql", ".ini", ".env", ".service", ".example"]
RAW_NAMES = ["dockerfile", "caddyfile", "makefile"]
DAILY, WORK_LOG = "01-Daily", "## 📝 Work Log & Session Notes"


def is_raw(rel_path: str) -> bool:
    low = rel_path.lower()
    return low.rsplit("/", 1)[-1] in RAW_NAMES or low.endswith(tuple(RAW_ENDINGS))


def index_of(rel_path: str) -> str | None:
    """The index note that should link to a note, if there is one."""
    return INDEX_NOTES.get(rel_path.split("/")[0]) if "/" in rel_path else None
