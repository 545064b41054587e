"""Training-data operators: ten corpus-scale jobs and the pipeline that chains five of them.

Nothing else in the library imports this subpackage.  ``registry`` lists its queries.
"""
