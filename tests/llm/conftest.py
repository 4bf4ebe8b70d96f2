"""Lets tests share the brute force of near duplicates."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.modules.setdefault("tests_near", __import__("test_near_dedup"))
