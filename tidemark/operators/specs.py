"""Definitions of the product metrics.  Defaults are the reference values."""

from __future__ import annotations

from dataclasses import dataclass


# Milestone definitions.
@dataclass(frozen=True)
class FunnelSpec:
    board_event: str = "board_created"
    invite_event: str = "member_invited"
    week2_from_days: int = 7
    week2_to_days: int = 14
    paid_plans: tuple = ("pro", "enterprise")


# Activation window, events and weights.
@dataclass(frozen=True)
class ActivationSpec:
    window_days: int = 7
    board_event: str = "board_created"
    invite_event: str = "member_invited"
    task_event: str = "task_created"
    board_tiers: tuple = ((1, 20),)
    invite_tiers: tuple = ((3, 40), (2, 30), (1, 15))
    task_tiers: tuple = ((5, 20), (2, 10))
    day_tiers: tuple = ((5, 20), (3, 10))
    max_score: int = 100
    activated_min_invites: int = 2


# Retention day -> window [lo, hi) in days since signup.
WINDOWS = ((1, 1, 8), (7, 7, 14), (14, 14, 21), (30, 30, 37), (60, 60, 67), (90, 90, 97))

# Funnel stage number -> lifecycle label.
STAGES = ((5, "converted"), (4, "retained_week2"), (3, "invited_member"),
          (2, "created_board"), (1, "signed_up_only"))
