import sys

from blockloom.cli import run

sys.exit(run())
