
from . import scans  # noqa: F401
from . import windows  # noqa: F401
from . import profile  # noqa: F401
from . import lookup  # noqa: F401
from . import rules  # noqa: F401
from . import similarity  # noqa: F401
from . import models  # noqa: F401
from . import extra  # noqa: F401
from . import ml_models  # noqa: F401
from . import recommend  # noqa: F401
from . import registry  # noqa: F401
from . import baselines  # noqa: F401
from . import boosted  # noqa: F401
from . import timeseries  # noqa: F401
from . import streaming  # noqa: F401
from . import artifacts  # noqa: F401
