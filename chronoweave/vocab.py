"""Vocabularies and parameters that are part of the semantics."""

# fixed values: event types by category
PASS_LIKE_OPEN = ["pass", "cross", "shot", "clearance", "keeper_punch", "shot_block"]
SET_PIECE_OOP = ["throw_in", "goalkick", "corner_short", "corner_crossed"]
SET_PIECE = [*SET_PIECE_OOP, "freekick_short", "freekick_crossed", "shot_freekick", "shot_penalty"]
INCOMING = ["interception", "keeper_save", "keeper_claim", "keeper_pick_up", "keeper_sweeper", "ball_recovery"]
MINOR = ["tackle", "take_on", "second_take_on", "foul", "bad_touch", "dispossessed"]

# fixed values: pitch in metres, frames a second, window lengths in seconds
PITCH_X, PITCH_Y = 105.0, 68.0
FPS = 25
EPISODE_GAP = 5
WINDOW_S = {"kickoff": 5, "pass_like": 10, "set_piece": 15, "incoming": 10, "minor": 10, "bad_touch": 5, "fault_like": 5}

TYPES = [*PASS_LIKE_OPEN, *SET_PIECE, *INCOMING, *MINOR]


def category(event_type: str) -> str | None:
    for name, members in (("pass_like", PASS_LIKE_OPEN), ("set_piece", SET_PIECE), ("incoming", INCOMING), ("minor", MINOR)):
        if event_type in members:
            return name
    return None
