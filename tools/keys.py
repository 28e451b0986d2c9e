"""Print the registered keys of one catalog module: python tools/keys.py q_detect"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from brokerlens.plans.catalog import REGISTRY  # noqa: E402

mods = sys.argv[1:]
print(" ".join(k for k, q in REGISTRY.items() if not mods or q.build.__module__.rsplit(".", 1)[-1] in mods))
