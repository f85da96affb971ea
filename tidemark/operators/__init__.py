"""DataFrame-in, DataFrame-out operators over keyed logs."""
