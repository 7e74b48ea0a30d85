"""Every threshold, in one place. Distances are metres, times seconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    # fixed values: defaults of the evidence rules
    step_s: float = 5.0
    max_gap_s: float = 30.0
    null_shifts_s: tuple = (600.0, 1200.0, 1800.0)
    awareness_m: float = 300.0
    associate_radius_m: float = 100.0
    associate_min_s: float = 600.0
    meet_radius_m: float = 150.0
    meet_min_s: float = 60.0
    apart_m: float = 500.0
    fight_grace_s: float = 120.0
    link_min: int = 3
    link_z: float = 3.0
    shared_s: float = 180.0
    reunion_s: float = 300.0
    heading_s: float = 15.0
    min_speed: float = 1.5
    aligned_cos: float = 0.95
    aligned_min_s: float = 60.0
    bridge_s: float = 15.0
    max_start_m: float = 3000.0
    arrive_m: float = 300.0
    arrive_grace_s: float = 15.0
    turn_s: float = 60.0
    max_approach: float = 0.3
    near_s: float = 600.0
    contact_m: float = 50.0
    respawn_m: float = 300.0
    spawn_min_s: float = 60.0
    spawn_min_own: int = 2
    spawn_min_others: int = 10
    still_speed: float = 0.5
    wait_min_s: float = 60.0
    wait_radius_m: float = 50.0
    wait_grace_s: float = 30.0
    wait_min: int = 3
    moving_min_s: float = 600.0
    beeline_ramp: tuple = (3.0, 7.0)
    contact_ramp: tuple = (1.0, 3.5)
    wait_ramp: tuple = (4.0, 8.0)
    weights: tuple = (1.0, 0.35, 0.9)
    flag_at: float = 0.6

    def steps(self, seconds: float) -> int:
        """A duration in whole grid steps, half to even, at least one."""
        return max(1, round(seconds / self.step_s))


#: The rules for positions made from events: samples lie minutes apart, and groups stay together only briefly.
EVENT_RULES = Rules(max_gap_s=300.0, associate_min_s=60.0)
