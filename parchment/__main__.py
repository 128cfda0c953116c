from parchment.cli import main

main()
