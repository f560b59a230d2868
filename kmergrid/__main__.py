import sys

from .plans.cli import run

run(sys.argv[1:])
