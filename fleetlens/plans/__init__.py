"""Plan graphs, checkpoints and plan accounting, over many plans at once."""
