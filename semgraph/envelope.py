"""How far an answer can be trusted: tier, band, limitations and staleness of each tool."""

from __future__ import annotations

from dataclasses import dataclass, field

# What kind of truth each tool gives.
_CLASSES = {
    ("Semantic", "Proven"): "analyze context lookup dependencies dependants resolve_member resolve_short_name partial_view invariant_check find_references find_definition find_implementations static_tables assignment_coverage callsite_arguments member_count struct_layout symbol_at_position documentation rename enum_coverage wire_audit feature_switch_audit",
    ("Derived", "Proven"): "capabilities blast_radius asmdef_check authority_report authority_coverage port_health cycles test_impact",
    ("Derived", "Advisory"): "file_impact",
    ("Heuristic", "Advisory"): "dead_code search",
}
_RISKS = {
    "authority_report": "a runtime may call members that no edge shows", "port_health": "a runtime may call members that no edge shows", "dead_code": "a runtime may call members that no edge shows",
    "test_impact": "tests are found by attributes only", "wire_audit": "wiring by reflection is not seen", "feature_switch_audit": "activation outside the graph is not seen", "enum_coverage": "a runtime may set values that no edge shows",
}


@dataclass
class Envelope:
    tier: str
    band: str
    limitations: list[str] = field(default_factory=list)
    stale: bool = False
    generation: int = 1


def decorate(tool: str, levels: dict[str, str] | None = None, age_s: float = 0, changed_files: int = 0, generation: int = 1, warn_s: float = 3_600) -> Envelope:
    """The envelope of a tool's answer; adapter levels below proven lower a proven band. An unknown tool is speculative."""
    for (tier, band), names in _CLASSES.items():
        if tool in names.split():
            out = Envelope(tier, band, generation=generation)
            break
    else:
        out = Envelope("Heuristic", "Speculative", generation=generation)
    if tool in _RISKS:
        out.limitations.append(_RISKS[tool])
    weak = sorted(k for k, v in (levels or {}).items() if v != "proven")
    if weak:
        out.limitations.append("adapter levels below proven: " + ", ".join(weak))
        if out.band == "Proven":
            out.band = "Advisory"
    if age_s > warn_s or changed_files:
        out.stale = True
        out.limitations.append(f"analyzed {int(age_s)} s ago, {changed_files} files changed since")
    return out


def capabilities() -> dict:
    names = sorted({n for v in _CLASSES.values() for n in v.split()})
    return {"server": "semgraph", "tools": names, "tool_count": len(names)}
