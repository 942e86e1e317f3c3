"""Settings of the series engine. The values are fixed: results must equal those that they were tuned for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Audio:
    sample_rate: int = 16_000
    nfft: int = 512
    hop: int = 128
    chunk_s: float = 10.0
    overlap_s: float = 2.0


@dataclass(frozen=True)
class Gate:
    open_db: float = -20.0
    close_db: float = -23.0
    reference: float = 0.95
    min_on_ms: int = 60
    min_off_ms: int = 10
    ramp_ms: int = 10
    frame_ms: int = 10
    lookahead_ms: int = 10
    veto_db: float = 4.0
    smooth_ms: int = 220
    hold_ms: int = 120
    min_range: float = 1e-4


@dataclass(frozen=True)
class Tracking:
    iou: float = 0.3
    gap: int = 12
    veto: float = 0.20
    same: float = 0.363
    max_tracks: int = 4
    min_frames: int = 12
    overlap: float = 0.05


@dataclass(frozen=True)
class Matching:
    smooth: int = 7
    confidence: float = 0.05
    p_value: float = 0.05


@dataclass(frozen=True)
class Identity:
    window_s: float = 2.0
    hop_s: float = 0.5
    loud_db: float = 12.0
    on: float = 0.05
    off: float = -0.05
    dwell_s: float = 0.40
    share: float = 0.04
    min_windows: int = 3
    extra: int = 3


@dataclass(frozen=True)
class Alignment:
    margin: float = 0.15
    silence_rms: float = 1e-3
    id_margin: float = 0.15
    id_cosine: float = 0.45
