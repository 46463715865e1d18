"""What to do about a risky change or a violation, as texts: steps of a refactoring, and a remedy's reason and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reason and the steps of each kind of remedy; {description}, {from} and {to} stand for the violation's.
REMEDIES = {
    "Insufficient Violation Data": (
        "The violation object is missing source or target node information.",
        "1. Ensure the violation was produced by check_architecture_violations.",
        "2. Verify that both source and target symbols exist in the knowledge graph.",
        "3. Re-run check_architecture_violations and pass one of the returned violation objects directly.",
    ),
    "Dependency Decoupling (Abstractions or Events)": (
        "Circular dependencies make the system rigid, hard to test, and prone to memory leaks.",
        "1. Identify the common functionality causing the cycle.",
        "2. Extract that shared logic into a new, independent module/helper.",
        "3. If extraction is not possible, use the Dependency Inversion Principle (DIP): Introduce an interface that one side implements and the other depends on.",
        "4. Alternatively, use an Event-driven approach: Replace direct calls with an Event Emitter/Listener.",
    ),
    "Dependency Inversion via Interface/DTO": (
        "Lower layers should not have knowledge of high-level API or Presentation layers.",
        "1. Extract an interface for the required functionality in the Domain/Core layer.",
        "2. Have the API layer implement this interface.",
        "3. Use Dependency Injection to provide the implementation to the lower layer.",
        "4. If transferring data, use simple Data Transfer Objects (DTO) defined in a common layer.",
    ),
    "Stateless Helper Extraction": (
        "Utility components must be stateless and cross-cutting. Depending on business services violates SRP.",
        "1. Identify if the utility actually needs the service logic.",
        "2. Move the business logic out of the utility and into a Service.",
        "3. Pass the required data as arguments to the utility method instead of having the utility fetch it.",
        "4. Ensure the utility is pure (stateless) and only operates on input arguments.",
    ),
    "Service-Layer Orchestration": (
        "Repositories should be isolated to their own domain. Cross-domain coordination belongs in the Service layer.",
        "1. Remove the direct call between repositories.",
        "2. Create a Service that coordinates the calls to both repositories.",
        "3. Ensure transactional integrity is managed at the Service level.",
    ),
    "Single Responsibility Principle (SRP) Decomposition": (
        "The component is too large and handles too many responsibilities (God Object).",
        "1. Group related methods and fields into logical sub-modules.",
        '2. Use the "Extract Class" or "Extract Function" refactoring pattern.',
        "3. Delegate specialized tasks to new, smaller components.",
        "4. Use composition over inheritance to rebuild the original functionality.",
    ),
    "Architectural Decoupling": (
        "Illegal relationship detected: {description}.",
        "1. Analyze the intent of the relationship between '{from}' and '{to}'.",
        "2. Identify if the dependency can be reversed using DIP.",
        "3. Check if the logic can be moved to a more appropriate layer/module.",
        "4. If the relationship is notification-based, use an Observer or Pub/Sub pattern.",
    ),
}
# The steps of a refactoring; the second ones depend on the risk.
REVIEW = "1. [Investigation] Review the detailed impact map for {name}."
ABSTRACT = ("2. [Abstraction] Introduce an interface or abstract class to decouple {name} from its callers.", '3. [Incremental] Apply changes using the "Branch by Abstraction" pattern.')
PREPARE = "2. [Preparation] Ensure unit tests cover all direct callers ({fan_in} nodes)."
VERIFY = "4. [Verification] Run full integration tests, focusing on: {first}..."
TIDY = "5. [Cleanup] Update documentation and historical context via 'backfill_history'."


def _filled(text: str, **values: Column) -> Column:
    out = F.lit(text)
    for key, value in values.items():
        if "{" + key + "}" in text:
            out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("null")))
    return out


def remedy(strategy: Column, description: Column, source: Column, target: Column) -> tuple[Column, Column]:
    """(rationale, steps) of a kind of remedy; an unknown kind has none."""
    fill = lambda t: _filled(t, description=description, **{"from": source, "to": target})
    reason, steps = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for name, (why, *how) in REMEDIES.items():
        reason = F.when(strategy == name, fill(why)).otherwise(reason)
        steps = F.when(strategy == name, F.array(*map(fill, how))).otherwise(steps)
    return reason, steps


def refactor_steps(name: Column, fan_in: Column, risk: Column, first: Column) -> Column:
    """The steps by the level of risk; ``first`` names the symbols that are reached first."""
    fill = lambda t: _filled(t, name=name, fan_in=fan_in, first=F.array_join(first, ", "))
    middle = F.when(risk.isin("CRITICAL", "HIGH"), F.array(*map(fill, ABSTRACT))).when(risk == "MEDIUM", F.array(fill(PREPARE))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(fill(REVIEW)), middle, F.array(fill(VERIFY), F.lit(TIDY)))
