"""Training-data operators: near-duplicate detection, classifiers, personal data and secret
scans, decontamination and packing.  Nothing else in the library imports this subpackage."""
