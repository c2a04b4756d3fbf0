"""Replay and lineage of compacted histories by hand."""

import pytest

from tracemill.operators import history as H

CONTEXTS = "run_id long, context_id string, turn_index int, active boolean, record_id string, summary_id string, carried_id string, selected array<string>"
RETAINED = "run_id long, entry_id string, turn_index int, source_kind string, control_kind string, record_id string, source_ids array<string>, source_indices array<int>, source_index int, role string, text string"


def message(run, name, at, text, role="user", kind="source_message"):
    return (run, name, at, kind, None, None, None, None, at, role, text)


def tables(spark, contexts, retained):
    return spark.createDataFrame(contexts, CONTEXTS), spark.createDataFrame(retained, RETAINED)


def base():
    return [
        *(message(1, f"m{i}", i, f"t{i}") for i in range(5)),
        (1, "sum", 5, "replacement_summary", None, "r", ["m2", "m0"], [2, 0], None, "user", "short"),
        (1, "car", 5, "carry_forward_state", None, "r", None, None, None, None, None),
        (1, "art", 5, "history_control", "compaction_artifact", None, None, None, None, None, None),
    ]


def test_sources_and_what_stays_interleave(spark):
    contexts, retained = tables(spark, [(1, "c", 5, True, "r", "sum", "car", ["sum", "m1", "m4", "m3"])], base())
    got = sorted((r.place, r.text, r.fault) for r in H.replayed(contexts, retained, strict=True).collect())
    assert got == [(i, f"t{i}", None) for i in range(5)]
    shown = sorted((r.place, r.text) for r in H.selected_messages(contexts, retained).collect())
    assert shown == [(0, "short"), (1, "t1"), (2, "t4"), (3, "t3")]
    report = H.lineage(contexts, retained).collect()
    assert [(r.ok, r.errors, r.artifact_id, r.source_ids) for r in report] == [(True, [], "art", ["m2", "m0"])]


def test_every_fault_of_one_context(spark):
    rows = [(1, "sum", 5, "x", None, "q", ["m2", "gone", "car"], [2, 0, 1], None, "user", "short"), (1, "car", 5, "y", None, "q", None, None, None, None, None), message(1, "m2", 2, "t2")]
    contexts, retained = tables(spark, [(1, "c", 5, True, "r", "sum", "car", ["car"])], rows)
    (found,) = H.lineage(contexts, retained).collect()
    assert found.errors == ["summary_kind", "summary_record", "carried_kind", "carried_record", "artifact_missing", "source_missing:gone", "source_kind:car", "summary_not_selected", "carried_selected"] and not found.ok
    whole = H.reconciliation(contexts, retained).collect()[0]
    assert whole.selected_roles == [] and whole.replayed_roles == [] and whole.errors[:2] == ["summary_kind", "summary_record"] and "no_message:car" in whole.errors


def test_the_last_of_repeated_entries_counts_and_other_rows_are_left_out(spark):
    contexts, retained = tables(spark, [(1, "c", 5, True, "r", "sum", "car", ["sum"]), (2, "c", 0, None, None, None, None, ["a", None]), (3, "c", 1, True, None, None, None, None), (4, "c", 1, True, "r", None, None, [])], [*base(), message(1, "m0", 9, "newer"), message(2, "a", 0, "alone")])
    rows = H.replayed(contexts, retained).collect()
    assert sorted((r.run_id, r.place, r.text or "", r.fault or "") for r in rows) == [(1, 0, "newer", ""), (1, 1, "t2", ""), (2, 0, "alone", ""), (2, 1, "", "entry_missing"), (3, 0, "", "no_summary"), (4, 0, "", "no_summary")]
    assert sorted(r.run_id for r in H.lineage(contexts, retained).collect()) == [1, 4]
    assert H.replayed(contexts.where("false"), retained).count() == 0 and H.reconciliation(contexts.where("false"), retained).count() == 0


def test_a_missing_entry_raises_in_strict_mode(spark):
    contexts, retained = tables(spark, [(1, "c", 5, True, "r", "sum", "car", ["sum", "lost"])], base())
    with pytest.raises(Exception, match="entry_missing 1 c lost"):
        H.replayed(contexts, retained, strict=True).collect()
