"""Training-data pipeline operators: tokens, de-duplication, classification, decontamination, packing."""
