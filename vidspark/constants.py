"""Values that results depend on."""

from __future__ import annotations

from datetime import datetime

# They must be as they are for equal results.
START_TIME = datetime(2021, 6, 8, 7, 10, 28)
DEFAULT_COLOR = "default_color"
DEFAULT_VOLUME = (0.01082532, 2.59647246, 0.0, 3.01034039, 3.35985782, 2.0)
VOLUME_Z = (0.0, 2.0)
LABEL_WIDTH, LABEL_HEIGHT = 3840, 2160
MIN_SCORE, MAX_IOU, MOST_A_CLASS, MOST_A_FRAME = 0.5, 0.45, 50, 50
MAX_COSINE_DISTANCE = 0.4
MAX_OVERLAP_DISTANCE, GREATEST_AGE, HITS_TO_CONFIRM = 0.7, 30, 3
MOTION_GATE = 9.4877
POSITION_WEIGHT, VELOCITY_WEIGHT = 1 / 20, 1 / 160
MIN_DEPTH, MAX_DEPTH = 0.1, 100.0
SSIM_C1, SSIM_C2 = 0.01**2, 0.03**2
DEPTH_RATIO = 1.25
OUTPUT_FOLDER = "./output"
