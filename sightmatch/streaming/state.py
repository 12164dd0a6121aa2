"""Step functions of the stateful streams: plain values in, plain values out."""

from __future__ import annotations

from sightmatch.params import EvidenceParams

# The memory of one evidence state, as a flat list that survives JSON:
# kept times, confirmed, time of the last candidate, time of the last hit, similarity, quality.
EMPTY = ((), False, None, None, None, None)


def on_face(
    memory: tuple, at: int, similarity: float, quality: float, threshold: float, p: EvidenceParams
) -> tuple[tuple, list[tuple]]:
    """Memory after a face, and the events it causes as (state, similarity, quality, count)."""
    kept, confirmed, shown, hit, _, _ = memory
    if similarity < threshold:
        return (kept, confirmed, shown, hit, similarity, quality), []
    kept = tuple(t for t in kept if at - t <= p.window_ms)
    if not kept or at - kept[-1] >= p.separation_ms:
        kept = (*kept, at)
    events = []
    if not confirmed:
        if shown is None or at - shown >= p.throttle_ms:
            events.append(("candidate", similarity, quality, len(kept)))
            shown = at
        if len(kept) >= p.required:
            events.append(("confirmed", similarity, quality, len(kept)))
            confirmed = True
    return (kept, confirmed, shown, at, similarity, quality), events


def on_tick(memory: tuple, at: int, p: EvidenceParams) -> tuple[tuple | None, list[tuple]]:
    """Memory after the end of a frame, None when there is nothing left to remember."""
    kept, confirmed, shown, hit, similarity, quality = memory
    kept = tuple(t for t in kept if at - t <= p.window_ms)
    if confirmed and at - hit >= p.grace_ms:
        return None, [("lost", similarity, quality, len(kept))]
    # Without evidence and with the throttle long past, a fresh state behaves the same.
    idle = hit is None or at - hit >= p.grace_ms
    if not confirmed and not kept and idle:
        return None, []
    return (kept, confirmed, shown, hit, similarity, quality), []
