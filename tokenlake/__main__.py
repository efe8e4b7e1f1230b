"""python -m tokenlake"""

from tokenlake.cli import main

main()
